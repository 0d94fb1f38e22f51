"""A bidirectional gated recurrent network over bytes, trained by backpropagation through time, in numpy."""

from __future__ import annotations

import numpy as np

#: Weights of one direction: of the input byte, of the state before, and the bias, for the gates z (keep), r (reset) and the candidate.
PARTS = ("wx", "wh", "b")


class BiGRU:
    """Labels every position of byte strings of one length; both directions read the whole string."""

    def __init__(self, hidden: int, labels: int, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w[f"{d}wx"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.w[f"{d}wh"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
            self.w[f"{d}b"] = np.zeros(3 * hidden, np.float32)
        self.w["out"] = rng.normal(0, 0.3, (2 * hidden, labels)).astype(np.float32)
        self.w["bias"] = np.zeros(labels, np.float32)

    def _pass(self, d: str, x: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction, length x batch x hidden; x is length x batch, in reading order."""
        hid = self.hidden
        table, wh = self.w[f"{d}wx"] + self.w[f"{d}b"], self.w[f"{d}wh"]
        wg, wc = wh[:, : 2 * hid], wh[:, 2 * hid :]
        h = np.zeros((x.shape[1], hid), np.float32)
        states = np.empty((*x.shape, hid), np.float32)
        wg, wc = np.ascontiguousarray(wg), np.ascontiguousarray(wc)
        for t, row in enumerate(x):
            a = np.take(table, row, axis=0)
            gates = h @ wg
            gates += a[:, : 2 * hid]
            gates *= 0.5  # the logistic function by way of tanh, in place
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :hid], gates[:, hid:]
            rh = r * h
            c = rh @ wc
            c += a[:, 2 * hid :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((h, z, r, rh, c))
            h = h - c
            h *= z
            h += c
            states[t] = h
        return states

    def states(self, x: np.ndarray) -> np.ndarray:
        """Both directions' states at each position; x is batch x length."""
        cols = np.ascontiguousarray(x.T)
        return np.concatenate([self._pass("f", cols, None), self._pass("b", cols[::-1], None)[::-1]], axis=2)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Log-probability of each label at each position, length x batch x labels."""
        return log_softmax(self.states(x) @ self.w["out"] + self.w["bias"])

    def pooled(self, x: np.ndarray, margin: int, wanted: np.ndarray) -> np.ndarray:
        """Probabilities of the labels summed over the wanted positions of each string, batch x labels.

        The first and last `margin` positions are context only. wanted: batch x (length - 2 * margin), True where a
        position counts. Every such position is labelled; states are turned to scores where they arise, not kept.
        """
        cols, labels = np.ascontiguousarray(x.T), len(self.w["bias"])
        scores = np.empty((*cols.shape, labels), np.float32)
        scores[:] = self.w["bias"]
        self._score("f", cols, self.w["out"][: self.hidden], scores)
        self._score("b", cols[::-1], self.w["out"][self.hidden :], scores[::-1])
        p = scores[margin : len(cols) - margin].reshape(-1, labels)
        np.exp(np.clip(p, -40, 40, out=p), out=p)
        weight = np.ascontiguousarray(wanted.T, np.float32).ravel()
        weight /= p @ np.ones(labels, np.float32)
        return np.einsum("tb,tbk->bk", weight.reshape(-1, len(x)), p.reshape(-1, len(x), labels), optimize=False).astype(np.float64)

    def _score(self, d: str, x: np.ndarray, out: np.ndarray, scores: np.ndarray) -> None:
        """What _pass computes, in place and without keeping states; each one's part of the label scores is added."""
        hid = self.hidden
        half = np.repeat(np.float32([0.5, 0.5, 1]), hid)  # the logistic function is tanh of half its argument
        table, wh = (self.w[f"{d}wx"] + self.w[f"{d}b"]) * half, self.w[f"{d}wh"] * half
        wg, wc, out = (np.ascontiguousarray(part) for part in (wh[:, : 2 * hid], wh[:, 2 * hid :], out))
        n = x.shape[1]
        h, c, a, gates, s = (np.zeros((n, k), np.float32) for k in (hid, hid, 3 * hid, 2 * hid, out.shape[1]))
        z, r, ag, ac = gates[:, :hid], gates[:, hid:], a[:, : 2 * hid], a[:, 2 * hid :]
        for t in range(len(x)):
            np.take(table, x[t], axis=0, out=a, mode="clip")
            np.matmul(h, wg, out=gates)
            gates += ag
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            np.matmul(r * h, wc, out=c)
            c += ac
            np.tanh(c, out=c)
            h -= c
            h *= z
            h += c
            scores[t] += np.matmul(h, out, out=s)

    def _back(self, d: str, x: np.ndarray, keep: list, dh_all: np.ndarray, grad: dict[str, np.ndarray]) -> None:
        """Backpropagation through time of one direction."""
        hid = self.hidden
        wh = self.w[f"{d}wh"]
        wg, wc = wh[:, : 2 * hid], wh[:, 2 * hid :]
        gx, gh, gb = (np.zeros_like(self.w[f"{d}{p}"]) for p in PARTS)
        dh = np.zeros_like(dh_all[0])
        inputs: list[np.ndarray] = []
        for t in range(len(x) - 1, -1, -1):
            h, z, r, rh, c = keep[t]
            dh = dh + dh_all[t]
            dc = dh * (1 - z) * (1 - c * c)
            drh = dc @ wc.T
            dgates = np.concatenate([dh * (h - c) * z * (1 - z), drh * h * r * (1 - r)], axis=1)
            da = np.concatenate([dgates, dc], axis=1)
            inputs.append(da)
            gb += da.sum(axis=0)
            gh[:, : 2 * hid] += h.T @ dgates
            gh[:, 2 * hid :] += rh.T @ dc
            dh = dh * z + drh * r + dgates @ wg.T
        order = np.argsort(x[::-1].ravel(), kind="stable")  # sums by input byte, as ranges of the sorted bytes
        found, first = np.unique(x[::-1].ravel()[order], return_index=True)
        gx[found] = np.add.reduceat(np.concatenate(inputs)[order], first, axis=0)
        grad[f"{d}wx"], grad[f"{d}wh"], grad[f"{d}b"] = gx, gh, gb

    def gradient(self, x: np.ndarray, y: np.ndarray, margin: int = 0) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions, each labelled with its string's label, and its gradient.

        The first and last `margin` positions are context only.
        """
        cols = np.ascontiguousarray(x.T)
        kf: list = []
        kb: list = []
        h = np.concatenate([self._pass("f", cols, kf), self._pass("b", cols[::-1], kb)[::-1]], axis=2)
        logp = log_softmax(h @ self.w["out"] + self.w["bias"])
        inner = slice(margin, x.shape[1] - margin)
        n = logp[inner].shape[0] * len(x)
        loss = -logp[inner, np.arange(len(y)), y].sum() / n
        delta = np.exp(logp)
        delta[:, np.arange(len(y)), y] -= 1
        delta /= n
        delta[: inner.start] = 0
        delta[inner.stop :] = 0
        grad = {"out": np.einsum("tbh,tbk->hk", h, delta, optimize=True), "bias": delta.sum(axis=(0, 1))}
        dh = delta @ self.w["out"].T
        hid = self.hidden
        self._back("f", cols, kf, dh[:, :, :hid], grad)
        self._back("b", cols[::-1], kb, dh[::-1, :, hid:], grad)
        return float(loss), grad

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 256, rate: float = 0.01, seed: int = 0, margin: int = 0) -> float:
        """Adam over seeded batches; the rate falls to a tenth. Returns the mean loss of the last tenth of the steps."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        for step in range(1, steps + 1):
            some = rng.integers(0, len(x), batch)
            loss, grad = self.gradient(x[some], y[some], margin)
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            now = rate * (1 - 0.9 * step / steps)
            for k, g in grad.items():
                g = g / max(1.0, norm)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.w[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-max(1, steps // 10) :]))


def log_softmax(x: np.ndarray) -> np.ndarray:
    """Over the last axis."""
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))
