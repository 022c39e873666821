"""Affine and projective transforms: small values on the driver, applied to points as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column

from stackwise.schema import require


@dataclass(frozen=True)
class Affine:
    """``x' = a x + b y + c``, ``y' = d x + e y + f``."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = 1.0
    f: float = 0.0

    @property
    def matrix(self) -> np.ndarray:
        return np.array([[self.a, self.b, self.c], [self.d, self.e, self.f], [0.0, 0.0, 1.0]])

    @classmethod
    def of(cls, matrix: np.ndarray) -> Affine:
        return cls(*(float(v) for v in matrix[:2].ravel()))

    def apply(self, x: Column | np.ndarray | float, y: Column | np.ndarray | float):
        return self.a * x + self.b * y + self.c, self.d * x + self.e * y + self.f

    def inverse(self) -> Affine:
        require(abs(self.a * self.e - self.b * self.d) > 0, "a singular transform has no inverse")
        return Affine.of(np.linalg.inv(self.matrix))

    def then(self, after: Affine) -> Affine:
        """First this, then ``after``."""
        return Affine.of(after.matrix @ self.matrix)

    def homography(self) -> Projective:
        return Projective.of(self.matrix)


@dataclass(frozen=True)
class Projective:
    """A homography in canonical form: divided by its first entry of greatest magnitude."""

    rows: tuple[tuple[float, float, float], ...]

    @classmethod
    def of(cls, matrix: np.ndarray) -> Projective:
        matrix = np.asarray(matrix, np.float64)
        require(bool(np.isfinite(matrix).all()) and abs(np.linalg.det(matrix)) > 0, "a homography must be finite and regular")
        pivot = matrix.ravel()[np.argmax(np.abs(matrix.ravel()))]
        return cls(tuple(tuple(float(v) + 0.0 for v in row) for row in matrix / pivot))

    @property
    def matrix(self) -> np.ndarray:
        return np.array(self.rows)

    def apply(self, x, y):
        """Mapped coordinates; a zero denominator (the horizon) gives no finite point."""
        (a, b, c), (d, e, f), (g, h, i) = self.rows
        w = g * x + h * y + i
        return (a * x + b * y + c) / w, (d * x + e * y + f) / w

    def inverse(self) -> Projective:
        return Projective.of(np.linalg.inv(self.matrix))

    def then(self, after: Projective) -> Projective:
        return Projective.of(after.matrix @ self.matrix)


#: Cells of 2 x 2 mosaic samples: cell ``u`` is at ``2 u + 0.5`` on the sensor.
CELL_TO_SENSOR = np.array([[2.0, 0.0, 0.5], [0.0, 2.0, 0.5], [0.0, 0.0, 1.0]])


def lift_affine(cells: Affine) -> Affine:
    """A transform between cell images as one between sensors."""
    return Affine.of(CELL_TO_SENSOR @ cells.matrix @ np.linalg.inv(CELL_TO_SENSOR))


def lift_projective(cells: Projective) -> Projective:
    return Projective.of(CELL_TO_SENSOR @ cells.matrix @ np.linalg.inv(CELL_TO_SENSOR))


def separation(first: Affine | Projective, second: Affine | Projective, width: int, height: int) -> float:
    """Greatest distance of the two images of the corners and the centre of a frame."""
    x = np.array([0.0, width - 1, 0.0, width - 1, (width - 1) / 2])
    y = np.array([0.0, 0.0, height - 1, height - 1, (height - 1) / 2])
    (x1, y1), (x2, y2) = first.apply(x, y), second.apply(x, y)
    return float(np.hypot(x1 - x2, y1 - y2).max())


def similarity_from_sums(n: float, sx: float, sy: float, su: float, sv: float, dot: float, cross: float, square: float, reflected: bool = False) -> Affine:
    """Least-squares similarity from sums over matches ``(x, y) -> (u, v)``.

    ``dot``, ``cross`` and ``square`` are centred: of ``x u + y v``, ``x v - y u`` and ``x x + y y``; for a reflection of
    ``x u - y v`` and ``x v + y u``.
    """
    require(square > 0, "matches must not all be at one point")
    a, b = dot / square, cross / square
    mx, my, mu, mv = sx / n, sy / n, su / n, sv / n
    if reflected:
        return Affine(a, b, mu - a * mx - b * my, b, -a, mv - b * mx + a * my)
    return Affine(a, -b, mu - a * mx + b * my, b, a, mv - b * mx - a * my)


def fit_similarity(source: np.ndarray, target: np.ndarray, reflected: bool = False) -> Affine:
    """Least-squares similarity (or its reflected kind) of matched points ``(n, 2)``."""
    require(len(source) >= 2, "a similarity needs two matches")
    (mx, my), (mu, mv) = source.mean(axis=0), target.mean(axis=0)
    x, y, u, v = source[:, 0] - mx, source[:, 1] - my, target[:, 0] - mu, target[:, 1] - mv
    dot, cross = ((x * u - y * v).sum(), (x * v + y * u).sum()) if reflected else ((x * u + y * v).sum(), (x * v - y * u).sum())
    n = float(len(source))
    return similarity_from_sums(n, n * mx, n * my, n * mu, n * mv, dot, cross, (x * x + y * y).sum(), reflected)


def _normaliser(points: np.ndarray) -> np.ndarray:
    centre = points.mean(axis=0)
    spread = np.hypot(*(points - centre).T).mean()
    require(spread > 0, "matches must not all be at one point")
    s = np.sqrt(2) / spread
    return np.array([[s, 0, -s * centre[0]], [0, s, -s * centre[1]], [0, 0, 1]])


#: Matches whose rows of the design are held at once.
DESIGN_ROWS = 1 << 14


def fit_projective(source: np.ndarray, target: np.ndarray, least_separation: float = 1e-10) -> tuple[Projective, float]:
    """Normalised direct linear transform; also the ratio of the last two but one singular values (rank evidence).

    The design is reduced to its triangular factor, which has the same singular values and right vectors, part by part:
    memory does not grow with the square of the matches.
    """
    require(len(source) >= 4, "a homography needs four matches")
    a, b = _normaliser(source), _normaliser(target)
    r = np.zeros((0, 9))
    for k in range(0, len(source), DESIGN_ROWS):
        x, y = a[:2, :2] @ source[k : k + DESIGN_ROWS].T + a[:2, 2:]
        u, v = b[:2, :2] @ target[k : k + DESIGN_ROWS].T + b[:2, 2:]
        zero, one = np.zeros_like(x), np.ones_like(x)
        design = [np.stack([-x, -y, -one, zero, zero, zero, u * x, u * y, u], axis=1), np.stack([zero, zero, zero, -x, -y, -one, v * x, v * y, v], axis=1)]
        r = np.linalg.qr(np.concatenate([r, *design]), mode="r")
    _, singular, basis = np.linalg.svd(r)
    ratio = float(singular[7] / singular[0])
    require(ratio > least_separation, "the matches do not determine a homography")
    return Projective.of(np.linalg.inv(b) @ basis[8].reshape(3, 3) @ a), ratio


def residuals(transform: Affine | Projective, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    u, v = transform.apply(source[:, 0], source[:, 1])
    return np.hypot(u - target[:, 0], v - target[:, 1])
