"""Kernels as Column expressions: small vector algebra, finite volumes, finite elements, Jacobi."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return reduce(lambda x, y: x + y, [p * q for p, q in zip(a, b, strict=True)])


def axpy(a, x, y) -> list:
    return [a * p + q for p, q in zip(x, y, strict=True)]


def lesser(a, b) -> Column:
    return F.least(a, b)


def greater(a, b) -> Column:
    return F.greatest(a, b)


class Gas:
    """A perfect gas's states (density, momenta, energy) in two dimensions and their fluxes."""

    def __init__(self, gam: float = 1.4, cfl: float = 0.9, eps: float = 0.05, mach: float = 0.4, attack: float = 0.0):
        import math

        import numpy as np

        # The published constants are single precision.
        self.gam, self.cfl, self.eps, mach = (float(np.float32(v)) for v in (gam, cfl, eps, mach))
        self.gm1 = self.gam - 1.0
        p, r = 1.0, 1.0
        u = math.sqrt(self.gam * p / r) * mach
        self.far = [r, r * u * math.cos(attack), r * u * math.sin(attack), p / self.gm1 + 0.5 * r * u * u]

    def pressure(self, q):
        return self.gm1 * (q[3] - 0.5 * (q[1] * q[1] + q[2] * q[2]) / q[0])

    def flux(self, q, normal):
        """The flux of a state through a face of normal (nx, ny)."""
        p = self.pressure(q)
        through = (q[1] * normal[0] + q[2] * normal[1]) / q[0]
        return [through * q[0], through * q[1] + p * normal[0], through * q[2] + p * normal[1], through * (q[3] + p)]

    def save(self, q):
        return {1: q}

    def time_step(self, corners, q):
        """The inverse local time step of a quadrilateral: wave speeds over its faces."""
        u, v = q[1] / q[0], q[2] / q[0]
        c = F.sqrt(self.gam * self.gm1 * (q[3] / q[0] - 0.5 * (u * u + v * v)))
        total = None
        for a, b in zip(corners, [*corners[1:], corners[0]], strict=True):
            dx, dy = b[0] - a[0], b[1] - a[1]
            one = F.abs(u * dy - v * dx) + c * F.sqrt(dx * dx + dy * dy)
            total = one if total is None else total + one
        return total / self.cfl

    def face(self, a, b, q1, q2, t1, t2):
        """What an inner face takes from its first cell and gives to its second."""
        normal = (a[1] - b[1], b[0] - a[0])
        mean = [0.5 * (x + y) for x, y in zip(self.flux(q1, normal), self.flux(q2, normal), strict=True)]
        mu = 0.5 * (t1 + t2) * self.eps
        out = [f + mu * (x - y) for f, x, y in zip(mean, q1, q2, strict=True)]
        return out, [-f for f in out]

    def boundary(self, a, b, q1, t1, flag):
        """A wall has its pressure only; the far field has the free stream beyond it."""
        normal = (a[1] - b[1], b[0] - a[0])
        p = self.pressure(q1)
        wall = [F.lit(0.0), p * normal[0], p * normal[1], F.lit(0.0)]
        far = [F.lit(x) for x in self.far]
        mean = [0.5 * (x + y) for x, y in zip(self.flux(q1, normal), self.flux(far, normal), strict=True)]
        mu = t1 * self.eps
        open_ = [f + mu * (x - y) for f, x, y in zip(mean, q1, far, strict=True)]
        return [F.when(flag == 1, w).otherwise(o) for w, o in zip(wall, open_, strict=True)]


# Bilinear elements on quadrilaterals: local nodes in order round the element, 2 x 2 Gauss points.
_GAUSS = 0.5 / 3**0.5
_POINTS = [(0.5 + sx * _GAUSS, 0.5 + sy * _GAUSS) for sx in (-1, 1) for sy in (-1, 1)]


def _gradients(x: float, y: float):
    """Derivatives of the four shape functions by the local coordinates."""
    return [-(1 - y), 1 - y, y, -y], [-(1 - x), -x, x, 1 - x]


def _points(corners):
    """For each Gauss point of an element: the derivatives (by x, by y) of its shape functions, and its determinant."""
    for x, y in _POINTS:
        gx, gy = _gradients(x, y)
        j = [[reduce(lambda p, q: p + q, [g[k] * corners[k][c] for k in range(4)]) for c in (0, 1)] for g in (gx, gy)]
        det = j[0][0] * j[1][1] - j[0][1] * j[1][0]
        yield [((gx[k] * j[1][1] - gy[k] * j[0][1]) / det, (gy[k] * j[0][0] - gx[k] * j[1][0]) / det) for k in range(4)], det


def stiffness(corners) -> list[Column]:
    """The 16 entries of an element's stiffness matrix, by rows."""
    total: list = [None] * 16
    for by, det in _points(corners):
        for a in range(4):
            for b in range(4):
                one = (by[a][0] * by[b][0] + by[a][1] * by[b][1]) * F.abs(det) * 0.25
                total[4 * a + b] = one if total[4 * a + b] is None else total[4 * a + b] + one
    return total


class Potential:
    """Compressible potential flow on bilinear elements, by what is known at the Gauss points of an element.

    A state's columns go point by point, so that each loop's expressions stay
    small: 8 derivatives, then (velocity x, y), then the density.
    """

    def __init__(self, mach: float = 0.1, gam: float = 1.4):
        self.mach, self.gm1 = mach, gam - 1.0

    def geometry(self, corners):
        """32 derivatives and 4 weights; the mesh stands still, so that they are made once."""
        found = list(_points(corners))
        return [d for by, _ in found for pair in by for d in pair], [F.abs(det) * 0.25 for _, det in found]

    def velocity(self, by, phi):
        return [dot([by[8 * g + 2 * k + c] for k in range(4)], phi) for g in range(4) for c in (0, 1)]

    def density(self, v):
        """By Bernoulli's law, and what it loses for a change of the squared speed: density over the law's base."""
        base = [1.0 + 0.5 * self.gm1 * (self.mach**2 - (v[2 * g] * v[2 * g] + v[2 * g + 1] * v[2 * g + 1])) for g in range(4)]
        return [F.pow(b, F.lit(1.0 / self.gm1)) for b in base], [F.pow(b, F.lit(1.0 / self.gm1 - 1.0)) for b in base]

    def element(self, by, weight, v, rho, drop):
        """The element's matrix of the linearised flux, 16 entries by rows, and its nodes' shares of the flux's balance."""
        along = [[v[2 * g] * by[8 * g + 2 * k] + v[2 * g + 1] * by[8 * g + 2 * k + 1] for k in range(4)] for g in range(4)]
        flux = [reduce(lambda p, q: p + q, [weight[g] * rho[g] * along[g][k] for g in range(4)]) for k in range(4)]

        def entry(a, b):
            parts = [weight[g] * (rho[g] * (by[8 * g + 2 * a] * by[8 * g + 2 * b] + by[8 * g + 2 * a + 1] * by[8 * g + 2 * b + 1]) - drop[g] * along[g][a] * along[g][b]) for g in range(4)]
            return reduce(lambda p, q: p + q, parts)

        return [entry(a, b) for a in range(4) for b in range(4)], flux


def element_product(k, p) -> list[Column]:
    """A symmetric element matrix times the values at its nodes; only the upper triangle is read."""
    at = lambda a, b: k[4 * min(a, b) + max(a, b)]
    return [dot([at(a, b) for b in range(4)], p) for a in range(4)]
