"""Matrices, vectors and causal sets as Spark relations."""

from __future__ import annotations

from tessera.functions.dtypes import DTYPES, precision_mode, resolve
from tessera.operators.array import DTypeWarning, Matrix, OverflowRiskWarning, PerformanceWarning, StorageWarning, Vector
from tessera.operators.blocks import Thunk, block_matrix
from tessera.operators.causal import CausalSet, Field, MinkowskiBox, MinkowskiCylinder, MinkowskiDiamond, ScalarField, Spacetime, causet, compute_k, sprinkle
from tessera.operators.elementwise import absolute, add_all, bitwise_not, cos, divide, exp, log, negative, sin, sqrt
from tessera.operators.indexing import submatrix
from tessera.operators.linalg import cholesky, cond, eig, eigh, eigvals, eigvals_arnoldi, eigvals_skew, eigvalsh, invert, lstsq, lu, pinv, qr, slogdet, solve, solve_triangular, svd
from tessera.operators.products import batch_gemv, matmul, outer
from tessera.operators.reductions import cross_product, determinant, dot, inner, norm, sum, trace
from tessera.plans.trace import clear_io_traces, get_io_streaming_threshold, get_memory_threshold, last_io_trace, last_kernel_trace, registry, set_io_streaming_threshold, set_memory_threshold
from tessera.sources.constructors import TYPED, I, antisymmetric_from_triangular, asarray, causal_matrix, diagonal_matrix, empty, from_frame, full, identity, matrix, ones, random_bits, random_causal, symmetric_from_triangular, unit_vector, vector, zeros
from tessera.sources.storage import convert_file, inspect, kept_inverse, load, load_npy, load_npz, save, save_npy, save_npz, set_backing_dir, set_export_max_bytes, to_numpy

globals().update(TYPED)
bitwise_invert = bitwise_not
__all__ = [k for k in globals() if not k.startswith("_") and k not in ("annotations", "functions", "operators", "plans", "sources")]
