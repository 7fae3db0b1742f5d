import itertools

import numpy as np
import pytest

from tessera.functions import dtypes as D


@pytest.mark.parametrize("a,b,op,want", [
    ("float32", "float64", "add", "float32"), ("float16", "float32", "matmul", "float16"), ("int32", "float16", "mul", "float16"), ("bit", "bit", "add", "int32"), ("bit", "bit", "hadamard", "bit"),
    ("bit", "bit", "outer", "bit"), ("bit", "int8", "add", "int8"), ("uint32", "int32", "add", "int64"), ("uint8", "int8", "add", "int16"), ("uint8", "int32", "add", "int32"), ("int8", "int16", "add", "int16"),
    ("int32", "int32", "divide", "float32"), ("float64", "complex_float32", "add", "complex_float32"), ("int64", "complex_float16", "add", "complex_float16"), ("complex_float64", "complex_float32", "mul", "complex_float32"),
])
def test_known(a, b, op, want):
    assert D.resolve(op, a, b) == D.resolve(op, b, a) == want


def test_total_and_symmetric():
    for op in ("add", "sub", "mul", "hadamard", "divide", "matmul", "matvec", "outer"):
        for a, b in itertools.product(D.DTYPES, repeat=2):
            clash = {a, b} & {"uint64"} and any(D.family(x) == "int" for x in (a, b))
            if clash and op != "divide":
                with pytest.raises(TypeError):
                    D.resolve(op, a, b)
            else:
                assert D.resolve(op, a, b) == D.resolve(op, b, a) in D.DTYPES


def test_highest_mode_is_scoped():
    with D.precision_mode("highest"):
        assert D.resolve("add", "float32", "float64") == "float64"
        assert D.resolve("divide", "int8", "int8") == "float64"
    assert D.resolve("add", "float32", "float64") == "float32"
    with pytest.raises(ValueError), D.precision_mode("middle"):
        pass


@pytest.mark.parametrize("given,want", [("half", "float16"), (float, "float64"), (bool, "bit"), (np.float32, "float32"), (np.dtype("uint8"), "uint8"), ("cf32", "complex_float32"), (complex, "complex_float64"), (np.complex64, "complex_float32")])
def test_names(given, want):
    assert D.normalize(given) == want


def test_unknown_name():
    with pytest.raises(TypeError):
        D.normalize("decimal")
