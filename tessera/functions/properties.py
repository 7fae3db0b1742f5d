"""Asserted properties of a matrix or vector: a checked mapping and how it goes through operations.

A property is asserted, never derived from values; an absent key means unknown.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, MutableMapping

FLAGS = (
    "is_zero is_identity is_permutation is_diagonal is_upper_triangular is_lower_triangular has_unit_diagonal has_zero_diagonal is_symmetric "
    "is_anti_symmetric is_hermitian is_skew_hermitian is_unitary is_atomic is_sorted is_strictly_sorted is_unit_norm"
).split()
DERIVED = ("trace", "determinant", "rank", "norm", "sum", "eigenvalues", "eigenvectors")
KEYS = {*FLAGS, *DERIVED, "diagonal_value"}
SQUARE = {"is_unitary", "is_hermitian", "is_skew_hermitian", "is_symmetric", "is_anti_symmetric", "is_permutation", "is_upper_triangular", "is_lower_triangular", "is_atomic", "trace", "determinant"}
#: What a true flag implies of others.
IMPLIES = {
    "is_identity": {"is_permutation": True, "is_diagonal": True, "is_upper_triangular": True, "is_lower_triangular": True, "has_unit_diagonal": True, "has_zero_diagonal": False, "diagonal_value": 1},
    "is_diagonal": {"is_upper_triangular": True, "is_lower_triangular": True},
    "has_unit_diagonal": {"has_zero_diagonal": False, "diagonal_value": 1},
    "has_zero_diagonal": {"diagonal_value": 0},
    "is_strictly_sorted": {"is_sorted": True},
}
#: Pairs that hold together only of a zero matrix.
EXCLUSIVE = (("is_symmetric", "is_anti_symmetric"), ("is_hermitian", "is_skew_hermitian"))


def check(props: Mapping, shape: tuple[int, int] | None = None) -> None:
    """Raise ValueError if the assertions contradict each other or the shape."""
    for key in props:
        if key not in KEYS:
            raise KeyError(f"unknown property {key!r}")
    if shape is not None and shape[0] != shape[1]:
        for key in SQUARE & set(props):
            if props[key] is True or key in DERIVED:
                raise ValueError(f"{key} needs a square matrix")
    for key, rest in IMPLIES.items():
        if props.get(key) is True:
            for other, value in rest.items():
                if other in props and props[other] != value:
                    raise ValueError(f"{key} contradicts {other}={props[other]!r}")
    if props.get("is_identity") is True and props.get("is_zero") is True and (shape is None or shape[0] * shape[1]):
        raise ValueError("is_identity contradicts is_zero")
    for a, b in EXCLUSIVE:
        if props.get(a) is True and props.get(b) is True and props.get("is_zero") is not True:
            raise ValueError(f"{a} and {b} hold together only with is_zero")
    if props.get("is_upper_triangular") is True and props.get("is_lower_triangular") is True and props.get("is_diagonal") is False:
        raise ValueError("upper and lower triangular contradict is_diagonal=False")


class Properties(MutableMapping):
    """A mapping that refuses a change that leads to a contradiction, and then stays as it was."""

    def __init__(self, values: Mapping | None = None, shape: tuple[int, int] | None = None):
        self._shape, self._values = shape, dict(values or {})
        check(self._values, shape)

    def __getitem__(self, key):
        return self._values[key]

    def __setitem__(self, key, value):
        if key in FLAGS and not isinstance(value, bool):
            raise TypeError(f"{key} is True or False")
        new = {**self._values, key: value}
        check(new, self._shape)
        self._values = new

    def __delitem__(self, key):
        del self._values[key]

    def __iter__(self) -> Iterator:
        return iter(self._values)

    def __len__(self):
        return len(self._values)

    def __repr__(self):
        return f"Properties({self._values!r})"


def _conj(v):
    return v.conjugate() if isinstance(v, complex) else v


def through(props: Mapping, op: str, real: bool) -> dict:
    """Properties after ``transpose``, ``conj`` or ``adjoint``."""
    out = dict(props)
    if op in ("transpose", "adjoint"):
        sides = {k: out.pop(k) for k in ("is_upper_triangular", "is_lower_triangular") if k in out}
        swap = {"is_upper_triangular": "is_lower_triangular", "is_lower_triangular": "is_upper_triangular"}
        out.update({swap[k]: v for k, v in sides.items()})
        out.pop("eigenvectors", None)
    if op in ("conj", "adjoint"):
        for k in ("diagonal_value", "trace", "determinant", "sum"):
            if k in out:
                out[k] = _conj(out[k])
        if "eigenvalues" in out:
            out["eigenvalues"] = [_conj(v) for v in out["eigenvalues"]]
        out.pop("eigenvectors", None)
    if op != "adjoint":
        for k in ("is_unitary", *(() if real else ("is_hermitian", "is_skew_hermitian"))):
            out.pop(k, None)
    return out


def scaled(props: Mapping, by, n: int | None) -> dict:
    """Properties after multiplication with a number; ``n`` is the size if square."""
    out = dict(props)
    for k in ("trace", "sum", "diagonal_value"):
        if k in out:
            out[k] = out[k] * by
    if "norm" in out:
        out["norm"] = out["norm"] * abs(by)
    if "determinant" in out:
        if n is None:
            del out["determinant"]
        else:
            out["determinant"] = out["determinant"] * by**n
    if by == 0 and "rank" in out:
        out["rank"] = 0
    for k in ("eigenvalues", "is_unit_norm", "is_sorted", "is_strictly_sorted"):
        out.pop(k, None)
    if by != 1:
        out.pop("has_unit_diagonal", None)
        for k in ("is_identity", "is_permutation"):
            if out.get(k) is True:
                out[k] = False
        if isinstance(by, complex) and by.imag:
            out.pop("is_hermitian", None)
            out.pop("is_skew_hermitian", None)
    if abs(by) != 1:
        out.pop("is_unitary", None)
    return out


def written(props: Mapping, above: bool, below: bool, diagonal: bool) -> dict:
    """Properties after values were written above, below or on the diagonal: only what a write cannot change stays."""
    out = {k: v for k, v in props.items() if k not in DERIVED}
    drop = {"is_zero", "is_identity", "is_permutation", "is_unitary", "is_atomic", "is_symmetric", "is_anti_symmetric", "is_hermitian", "is_skew_hermitian", "is_sorted", "is_strictly_sorted", "is_unit_norm"}
    if above or below:
        drop |= {"is_diagonal"} | ({"is_lower_triangular"} if above else set()) | ({"is_upper_triangular"} if below else set())
    if diagonal:
        drop |= {"has_unit_diagonal", "has_zero_diagonal", "diagonal_value"}
    return {k: v for k, v in out.items() if k not in drop}


def effective_structure(props: Mapping) -> str:
    """The narrowest asserted structure."""
    true = {k for k, v in props.items() if v is True}
    if {"is_upper_triangular", "is_lower_triangular"} <= true:
        true.add("is_diagonal")
    for flag, name in (("is_zero", "zero"), ("is_identity", "identity"), ("is_diagonal", "diagonal"), ("is_upper_triangular", "upper_triangular"), ("is_lower_triangular", "lower_triangular")):
        if flag in true:
            return name
    return "general"
