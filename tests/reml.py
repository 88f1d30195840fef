"""Dense-loop version of the random-intercept fit, one key at a time."""

import numpy as np
import pandas as pd


class Reml:
    """Likelihood of one key over its size classes."""

    def __init__(self, g: pd.DataFrame):
        self.g = {c: g[c].to_numpy(float) for c in
                  ("size", "m", "sx", "sy", "xx", "xy", "yy", "sxsx", "sxsy", "sysy")}
        self.rows = float(np.sum(self.g["size"] * self.g["m"]))

    def parts(self, theta: float):
        g = self.g
        c = theta / (1.0 + theta * g["size"])
        u = 1.0 - c * g["size"]
        a00, a01 = np.sum(g["m"] * g["size"] * u), np.sum(g["sx"] * u)
        a11 = np.sum(g["xx"] - c * g["sxsx"])
        b0, b1 = np.sum(g["sy"] * u), np.sum(g["xy"] - c * g["sxsy"])
        det = a00 * a11 - a01 * a01
        slope = (a00 * b1 - a01 * b0) / det
        level = (a11 * b0 - a01 * b1) / det
        q = np.sum(g["yy"] - c * g["sysy"]) - level * b0 - slope * b1
        log_det = np.sum(g["m"] * np.log1p(theta * g["size"])) + np.log(det)
        return slope, a00 / det, q, log_det

    def profile(self, theta: float) -> float:
        _, _, q, log_det = self.parts(theta)
        free = self.rows - 2.0
        return free * np.log(max(q, 1e-300) / free) + log_det

    def gradient(self, theta: float) -> float:
        """Derivative of the profile; its root is sharper than the flat minimum."""
        g = self.g
        _, _, q, _ = self.parts(theta)
        down = 1.0 / (1.0 + theta * g["size"]) ** 2
        c = theta / (1.0 + theta * g["size"])
        u = 1.0 - c * g["size"]
        a = np.array([[np.sum(g["m"] * g["size"] * u), np.sum(g["sx"] * u)],
                      [np.sum(g["sx"] * u), np.sum(g["xx"] - c * g["sxsx"])]])
        da = -np.array([[np.sum(g["m"] * g["size"] ** 2 * down), np.sum(g["sx"] * g["size"] * down)],
                        [np.sum(g["sx"] * g["size"] * down), np.sum(g["sxsx"] * down)]])
        db = -np.array([np.sum(g["sy"] * g["size"] * down), np.sum(g["sxsy"] * down)])
        beta = np.linalg.solve(a, [np.sum(g["sy"] * u), np.sum(g["xy"] - c * g["sxsy"])])
        dq = -np.sum(g["sysy"] * down) - 2.0 * beta @ db + beta @ da @ beta
        return float((self.rows - 2.0) * dq / q + np.sum(g["m"] * g["size"] / (1.0 + theta * g["size"]))
                     + np.trace(np.linalg.solve(a, da)))

    def deviance(self, tau: float, sigma: float) -> float:
        _, _, q, log_det = self.parts(tau * tau)
        return 2.0 * (self.rows - 2.0) * np.log(sigma) + log_det + q / sigma ** 2

    def slope_variance(self, tau: float, sigma: float) -> float:
        return sigma ** 2 * self.parts(tau * tau)[1]

    def ratio(self) -> float:
        """Variance ratio with the smallest criterion: grid, then the gradient's root."""
        grid = np.concatenate([[0.0], np.logspace(-8, 8, 161)])
        best = int(np.argmin([self.profile(t) for t in grid]))
        if best == 0:
            return 0.0
        lo, hi = np.log(grid[max(best - 1, 1)]), np.log(grid[min(best + 1, len(grid) - 1)])
        for _ in range(80):
            middle = 0.5 * (lo + hi)
            if self.gradient(np.exp(middle)) < 0.0:
                lo = middle
            else:
                hi = middle
        theta = float(np.exp(0.5 * (lo + hi)))
        return theta if self.profile(theta) < self.profile(0.0) - 1e-10 else 0.0

    def denominator_df(self, tau: float, sigma: float) -> float:
        """Satterthwaite degrees of freedom of the slope."""
        if tau == 0.0:
            return self.rows - 2.0
        at, h = np.array([tau, sigma]), np.array([tau, sigma]) * 1e-3

        def second(i, j):
            def f(si, sj):
                v = at.copy()
                v[i] += si * h[i]
                v[j] += sj * h[j]
                return self.deviance(*v)
            if i == j:
                return (f(1, 0) - 2.0 * f(0, 0) + f(-1, 0)) / h[i] ** 2
            return (f(1, 1) - f(1, -1) - f(-1, 1) + f(-1, -1)) / (4.0 * h[i] * h[j])

        hess = np.array([[second(0, 0), second(0, 1)], [second(0, 1), second(1, 1)]])
        grad = np.empty(2)
        for i in range(2):
            up, down = at.copy(), at.copy()
            up[i] += h[i]
            down[i] -= h[i]
            grad[i] = (self.slope_variance(*up) - self.slope_variance(*down)) / (2.0 * h[i])
        values, vectors = np.linalg.eigh(hess)
        good = values > 1e-8 * max(values.max(), 1e-300)
        spread = 2.0 * np.sum((vectors[:, good].T @ grad) ** 2 / values[good])
        return 2.0 * self.slope_variance(tau, sigma) ** 2 / spread
