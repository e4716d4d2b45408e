"""Ball trees over rows of numbers, with bounds that rounding cannot make too narrow."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Relative widening of radii and bounds: far above what float64 loses over some thousand components.
SLACK = 1e-9


@dataclass
class BallTree:
    """Node i covers places lo[i]:hi[i] of `order`; children are left[i], right[i], or -1 at a leaf."""

    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray
    center: np.ndarray
    radius: np.ndarray

    def product_bounds(self, node: int, q: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """No row of the node has an inner product with a row of q outside of these; `norm` holds the lengths of q's rows."""
        at, reach = q @ self.center[node], norm * self.radius[node]
        slack = SLACK * (norm * np.sqrt(self.center[node] @ self.center[node]) + reach) + SLACK
        return at - reach - slack, at + reach + slack

    def nearest_bound(self, node: int, q: np.ndarray) -> np.ndarray:
        """No row of the node is nearer to a row of q than this."""
        far = np.sqrt(((q - self.center[node]) ** 2).sum(1))
        return np.maximum(far * (1 - SLACK) - self.radius[node] - SLACK, 0)


def ball_tree(x: np.ndarray, leaf: int) -> BallTree:
    """Splits at the median along the line between two far rows until `leaf` rows are left; equal rows are dealt to both sides."""
    x = np.asarray(x, float)
    order, nodes = np.arange(len(x)), []

    def grow(lo: int, hi: int) -> int:
        rows = x[order[lo:hi]]
        center = rows.mean(0)
        away = ((rows - center) ** 2).sum(1)
        me = len(nodes)
        radius = np.sqrt(away.max()) * (1 + SLACK) + SLACK * (1 + np.abs(center).max(initial=0))
        nodes.append([lo, hi, -1, -1, center, radius])
        if hi - lo > leaf:
            one = rows[away.argmax()]
            other = rows[((rows - one) ** 2).sum(1).argmax()]
            mid = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(rows @ (other - one), mid)]
            nodes[me][2], nodes[me][3] = grow(lo, lo + mid), grow(lo + mid, hi)
        return me

    if len(x):
        grow(0, len(x))
    columns = list(zip(*nodes, strict=True)) or [()] * 6
    lo, hi, left, right = (np.array(c, np.int64) for c in columns[:4])
    return BallTree(order, lo, hi, left, right, np.array(columns[4], float).reshape(len(nodes), x.shape[1]), np.array(columns[5], float))
