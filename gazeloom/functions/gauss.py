"""Normal distributions as columns, and the probability mass of board cells."""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gazeloom import config as C
from gazeloom.functions.scalar import lit

# Quadrature of order 24 on [0, 1].
_X, _W = np.polynomial.legendre.leggauss(24)
NODES = [float(0.5 * (x + 1.0)) for x in _X]
WEIGHTS = [float(0.5 * w) for w in _W]

# Abramowitz & Stegun 7.1.26: error function, |error| <= 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
SQRT2 = 1.4142135623730951
#: How many of the heaviest cells a distribution names, and the least mass of such a cell.
TOP, LEAST_MASS = 3, 0.02


def phi(z: Column) -> Column:
    """Standard normal distribution function."""
    a = F.abs(z) / lit(SQRT2)
    t = lit(1) / (lit(1) + lit(ERF_P) * a)
    a1, a2, a3, a4, a5 = (lit(v) for v in ERF_A)
    tail = ((((a5 * t + a4) * t + a3) * t + a2) * t + a1) * t * F.exp(-a * a)
    return F.when(z >= 0, lit(1) - tail / lit(2)).otherwise(tail / lit(2))


def _rule() -> Column:
    return F.array(*[F.struct(lit(x).alias("x"), lit(w).alias("w")) for x, w in zip(NODES, WEIGHTS)])


def phi2(h: Column, k: Column, rho: Column) -> Column:
    """P(X <= h, Y <= k) for standard normals with correlation ``rho``.

    Product of the margins plus the integral of the density over the correlation.
    """
    r = F.greatest(lit(-0.999999), F.least(lit(0.999999), rho))

    def add(acc, node):
        t = node["x"] * r
        d = lit(1) - t * t
        return acc + node["w"] * F.exp(
            -(h * h - lit(2) * t * h * k + k * k) / (lit(2) * d)) / (lit(2 * math.pi) * F.sqrt(d))

    tilt = F.aggregate(_rule(), lit(0), add)
    base = phi(h) * phi(k)
    return F.when(F.abs(r) < lit(1e-12), base).otherwise(base + r * tilt)


def _standard(xx: Column, xy: Column, yy: Column):
    sx, sy = F.sqrt(F.greatest(xx, lit(1e-12))), F.sqrt(F.greatest(yy, lit(1e-12)))
    return sx, sy, xy / (sx * sy)


def cell_mass(mx: Column, my: Column, xx: Column, xy: Column, yy: Column, col: Column, row: Column,
              cols: int = C.BOARD_COLS, rows: int = C.BOARD_ROWS) -> Column:
    """Mass of N((mx, my), cov) inside one board cell."""
    sx, sy, rho = _standard(xx, xy, yy)
    edge = lambda i, n, m, s: (i.cast("double") / lit(n) - m) / s
    x0, x1 = edge(col, cols, mx, sx), edge(col + 1, cols, mx, sx)
    y0, y1 = edge(row, rows, my, sy), edge(row + 1, rows, my, sy)
    return F.greatest(lit(0), phi2(x1, y1, rho) - phi2(x0, y1, rho) - phi2(x1, y0, rho) + phi2(x0, y0, rho))


def cells_of(masses: Column) -> Column:
    """ARRAY<STRUCT<mass, col, row>> from the 40 row-major masses of ``board_masses_udf``."""
    return F.transform(masses, lambda m, i: F.struct(
        m.alias("mass"), (i % C.BOARD_COLS).alias("col"), F.floor(i / C.BOARD_COLS).cast("int").alias("row")))


def heaviest_cells(found: Column) -> Column:
    """The cells of ``heaviest_cells_udf``, heaviest first, in the form of ``cells_of``."""
    cell = lambda k: F.struct(found[f"mass_{k}"].alias("mass"), (found[f"cell_{k}"] % C.BOARD_COLS).alias("col"), F.floor(found[f"cell_{k}"] / C.BOARD_COLS).cast("int").alias("row"))
    return F.when(found["kept"] >= 0, F.slice(F.array(*map(cell, range(TOP))), F.lit(1), found["kept"]))


def top_cells(cells: Column, k: int = TOP, min_mass: float = LEAST_MASS) -> Column:
    kept = F.filter(cells, lambda c: c["mass"] >= lit(min_mass))
    return F.slice(F.reverse(F.array_sort(kept)), 1, k)


def distribution_text(cells: Column, k: int = TOP, min_mass: float = LEAST_MASS) -> Column:
    """``col,row:0.00`` of the heaviest cells, separated by ``|``."""
    return F.array_join(F.transform(top_cells(cells, k, min_mass), lambda c: F.format_string(
        "%d,%d:%.2f", c["col"], c["row"], c["mass"])), "|")


def onboard_mass(cells: Column) -> Column:
    return onboard(F.aggregate(cells, lit(0), lambda a, c: a + c["mass"]))


def onboard(total: Column) -> Column:
    return F.bround(F.least(total, lit(1)), 3)
