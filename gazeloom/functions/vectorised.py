"""Cell mass over Arrow batches: the same sums as :mod:`gazeloom.functions.gauss`, vectorised.

The quadrature needs 24 exponentials per corner; as nested column lambdas they would be
interpreted row by row.
"""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeloom import config as C
from gazeloom.functions import gauss


def _phi(z):
    a = np.abs(z) / gauss.SQRT2
    t = 1.0 / (1.0 + gauss.ERF_P * a)
    a1, a2, a3, a4, a5 = gauss.ERF_A
    tail = ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * np.exp(-a * a) / 2.0
    return np.where(z >= 0, 1.0 - tail, tail)


def _phi2(h, k, rho):
    x, w = np.array(gauss.NODES), np.array(gauss.WEIGHTS)
    t = rho[:, None] * x
    d = 1.0 - t * t
    q = (h * h + k * k)[:, None] - 2.0 * t * (h * k)[:, None]
    base = _phi(h) * _phi(k)
    return base + rho * ((np.exp(-q / (2.0 * d)) / (2.0 * np.pi * np.sqrt(d))) @ w)


@F.pandas_udf(T.DoubleType())
def cell_mass_udf(mx: pd.Series, my: pd.Series, xx: pd.Series, xy: pd.Series, yy: pd.Series,
                  col: pd.Series, row: pd.Series) -> pd.Series:
    mx, my, xx, xy, yy, col, row = (s.to_numpy(float) for s in (mx, my, xx, xy, yy, col, row))
    sx, sy = np.sqrt(np.maximum(xx, 1e-12)), np.sqrt(np.maximum(yy, 1e-12))
    rho = np.clip(xy / (sx * sy), -0.999999, 0.999999)
    x0, x1 = ((col + i) / C.BOARD_COLS - mx for i in (0, 1))
    y0, y1 = ((row + i) / C.BOARD_ROWS - my for i in (0, 1))
    x0, x1, y0, y1 = x0 / sx, x1 / sx, y0 / sy, y1 / sy
    m = _phi2(x1, y1, rho) - _phi2(x0, y1, rho) - _phi2(x1, y0, rho) + _phi2(x0, y0, rho)
    return pd.Series(np.maximum(m, 0.0))


#: Rows whose corners are computed together: their nodes stay in the processor's cache.
TOGETHER = 1024


def _board_masses(mx, my, xx, xy, yy):
    """Mass of each of the 40 cells of a few rows, row by row. What a row's corners share of the quadrature is computed once."""
    sx, sy = np.sqrt(np.maximum(xx, 1e-12)), np.sqrt(np.maximum(yy, 1e-12))
    rho = np.clip(xy / (sx * sy), -0.999999, 0.999999)
    zx = (np.arange(C.BOARD_COLS + 1) / C.BOARD_COLS - mx[:, None]) / sx[:, None]
    zy = (np.arange(C.BOARD_ROWS + 1) / C.BOARD_ROWS - my[:, None]) / sy[:, None]
    nodes, w = np.array(gauss.NODES), np.array(gauss.WEIGHTS)
    t = rho[:, None] * nodes
    d = 1.0 - t * t
    twice_t, twice_d, scale = 2.0 * t, 2.0 * d, 2.0 * np.pi * np.sqrt(d)
    corners = _phi(zy)[:, :, None] * _phi(zx)[:, None, :]
    for r, c in np.ndindex(corners.shape[1:]):
        h, k = zx[:, c], zy[:, r]
        e = (h * h + k * k)[:, None] - twice_t * (h * k)[:, None]
        np.divide(np.negative(e, out=e), twice_d, out=e)
        np.divide(np.exp(e, out=e), scale, out=e)
        corners[:, r, c] += rho * (e @ w)
    mass = corners[:, 1:, 1:] - corners[:, :-1, 1:] - corners[:, 1:, :-1] + corners[:, :-1, :-1]
    return np.maximum(mass, 0.0).reshape(len(mx), -1)


def _known_masses(*columns):
    """Which rows have a place and a covariance, and their masses."""
    columns = [s.to_numpy(float) for s in columns]
    known = np.isfinite(sum(columns))
    columns = [v[known] for v in columns]
    masses = np.empty((len(columns[0]), C.BOARD_COLS * C.BOARD_ROWS))
    for at in range(0, len(masses), TOGETHER):
        masses[at: at + TOGETHER] = _board_masses(*[v[at: at + TOGETHER] for v in columns])
    return known, masses


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def board_masses_udf(mx: pd.Series, my: pd.Series, xx: pd.Series, xy: pd.Series, yy: pd.Series) -> pd.Series:
    """Mass of each of the 40 cells, row by row. Cells share their 9 x 6 corners. NULL without a covariance."""
    known, masses = _known_masses(mx, my, xx, xy, yy)
    out = np.empty(len(known), dtype=object)
    for i, row in zip(np.flatnonzero(known), masses):
        out[i] = row
    return pd.Series(out)


# Cells from the last column to the first, and in a column from the last row: the order of equal masses in ``gauss.top_cells``.
_FROM_LAST = np.array([row * C.BOARD_COLS + col for col in reversed(range(C.BOARD_COLS)) for row in reversed(range(C.BOARD_ROWS))], np.int32)


_HEAVIEST = T.StructType([T.StructField("kept", T.IntegerType()), *[T.StructField(f"{c}_{k}", t) for k in range(gauss.TOP) for c, t in (("mass", T.DoubleType()), ("cell", T.IntegerType()))],
                          T.StructField("total", T.DoubleType())])


@F.pandas_udf(_HEAVIEST)
def heaviest_cells_udf(mx: pd.Series, my: pd.Series, xx: pd.Series, xy: pd.Series, yy: pd.Series) -> pd.DataFrame:
    """The heaviest cells of ``gauss.top_cells``, how many there are (-1 without a covariance), and the sum of all 40 masses."""
    known, masses = _known_masses(mx, my, xx, xy, yy)
    turned = masses[:, _FROM_LAST]
    first = np.argsort(-turned, axis=1, kind="stable")[:, :gauss.TOP]
    top, total = np.take_along_axis(turned, first, 1), np.zeros(len(masses))
    for k in range(masses.shape[1]):  # in the order of the cells, as gauss.onboard_mass adds them
        total += masses[:, k]

    def of_all(values, missing):
        out = np.full(len(known), missing, values.dtype)
        out[known] = values
        return out

    out = {"kept": of_all((top >= gauss.LEAST_MASS).sum(1).astype(np.int32), -1)}
    for k in range(gauss.TOP):
        out[f"mass_{k}"], out[f"cell_{k}"] = of_all(top[:, k], np.nan), of_all(_FROM_LAST[first[:, k]], -1)
    return pd.DataFrame(out | {"total": of_all(total, np.nan)})
