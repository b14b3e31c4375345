"""A small bidirectional LSTM over block sequences, trained and run in numpy."""

from __future__ import annotations

import numpy as np

from .blocks import NUMBERS, PATH_SIZE, WORD_SIZE

HIDDEN = 16


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-v))


class BiLstm:
    """Block inputs are the sum of a path's and a text's projection; each block gets the probability of being main text."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.h = h = hidden
        self.p = {
            "path": rng.normal(0, 0.15, (PATH_SIZE, 8 * h)),
            "text": rng.normal(0, 0.15, (WORD_SIZE + NUMBERS, 8 * h)),
            "bias": np.tile(np.repeat([0.0, 1.0, 0.0, 0.0], h), 2),
            "fore": rng.normal(0, 0.2, (h, 4 * h)),
            "back": rng.normal(0, 0.2, (h, 4 * h)),
            "out": rng.normal(0, 0.2, 2 * h + 8 * h),
            "off": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool):
        """States of one direction over time-major ``x``; ``keep``: what the way back needs."""
        t, b, h = x.shape[0], x.shape[1], self.h
        hs, kept = np.zeros((t, b, h), np.float32), []
        hidden = cell = np.zeros((b, h), np.float32)
        for s in range(t):
            z = x[s] + hidden @ u
            i, f, o = (_sigmoid(z[:, k * h : (k + 1) * h]) for k in range(3))
            g = np.tanh(z[:, 3 * h :])
            m = mask[s][:, None]
            before, was = cell, hidden
            cell = m * (f * cell + i * g)
            tc = np.tanh(cell)
            hidden = m * (o * tc)
            hs[s] = hidden
            if keep:
                kept.append((i, f, o, g, m, before, was, tc))
        return hs, kept

    def _unrun(self, dhs: np.ndarray, kept, u: np.ndarray):
        t, b, h = dhs.shape
        dx, du = np.zeros((t, b, 4 * h), np.float32), np.zeros_like(u)
        dh = dc = np.zeros((b, h), np.float32)
        for s in range(t - 1, -1, -1):
            i, f, o, g, m, before, was, tc = kept[s]
            dh = m * (dh + dhs[s])
            dc = m * (dc + dh * o * (1 - tc * tc))
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dx[s] = dz
            du += was.T @ dz
            dh, dc = dz @ u.T, dc * f
        return dx, du

    def _states(self, x: np.ndarray, mask: np.ndarray, keep: bool):
        h = self.h
        fore, kf = self._run(x[:, :, : 4 * h], mask, self.p["fore"], keep)
        back, kb = self._run(x[::-1, :, 4 * h :], mask[::-1], self.p["back"], keep)
        states = np.concatenate([fore, back[::-1], np.tanh(x)], axis=2)
        return states, _sigmoid(states @ self.p["out"] + self.p["off"]), kf, kb

    def project(self, vectors: np.ndarray, numbers: np.ndarray, path: np.ndarray) -> np.ndarray:
        """Inputs of blocks: ``vectors`` (one for each path), ``path`` of each block."""
        return (vectors.astype(np.float32) @ self.p["path"])[path] + numbers @ self.p["text"] + self.p["bias"]

    @staticmethod
    def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t = max(map(len, parts))
        x, mask = np.zeros((t, len(parts), *parts[0].shape[1:]), np.float32), np.zeros((t, len(parts)), np.float32)
        for k, p in enumerate(parts):
            x[: len(p), k], mask[: len(p), k] = p, 1
        return x, mask

    def predict(self, inputs: list[np.ndarray], most: int = 64, cells: int = 16_384) -> list[np.ndarray]:
        """Probabilities for each page's blocks; pages of like length share a batch of at most ``cells`` padded blocks."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(inputs)
        order = sorted((i for i, x in enumerate(inputs) if len(x)), key=lambda i: len(inputs[i]))
        batches: list[list[int]] = []
        for i in order:  # the longest of a batch is the one that is added last
            if batches and len(batches[-1]) < most and (len(batches[-1]) + 1) * len(inputs[i]) <= cells:
                batches[-1].append(i)
            else:
                batches.append([i])
        for some in batches:
            x, mask = self._padded([inputs[i] for i in some])
            _, p, _, _ = self._states(x, mask, False)
            for k, i in enumerate(some):
                out[i] = p[: len(inputs[i]), k]
        return out

    def train(self, pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]], vectors: np.ndarray, steps: int, rate: float = 0.01, batch: int = 32, seed: int = 0) -> None:
        """Adam on the mean cross-entropy of blocks; ``pages``: path numbers, number rows and labels of each page's blocks."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        h = self.h
        for step in range(1, steps + 1):
            some = [pages[i] for i in rng.integers(0, len(pages), batch)]
            path, mask = self._padded([p for p, _, _ in some])
            path = path.astype(int)
            numbers, _ = self._padded([n for _, n, _ in some])
            label, _ = self._padded([y.astype(np.float32) for _, _, y in some])
            used, at = np.unique(path, return_inverse=True)
            at = at.reshape(path.shape)
            shown = mask * (rng.random(mask.shape) > 0.3)  # some blocks show no text, and all show only some of their words
            numbers = numbers * shown[:, :, None] * np.concatenate([rng.random(WORD_SIZE) > 0.5, np.ones(NUMBERS)]).astype(np.float32)
            numbers = numbers.astype(np.float32)
            known = vectors[used].astype(np.float32) * (rng.random(vectors[used].shape) > 0.1)  # some names go missing
            x = (known @ self.p["path"])[at] + numbers @ self.p["text"] + self.p["bias"]
            states, p, kf, kb = self._states(x, mask, True)
            d = (p - label) * mask / mask.sum()
            grad = {"out": np.einsum("tb,tbk->k", d, states), "off": np.array([d.sum()], np.float32)}
            ds = d[:, :, None] * self.p["out"]
            dx = ds[:, :, 2 * h :] * (1 - states[:, :, 2 * h :] ** 2)
            df, grad["fore"] = self._unrun(ds[:, :, :h], kf, self.p["fore"])
            db, grad["back"] = self._unrun(ds[::-1, :, h : 2 * h], kb, self.p["back"])
            dx[:, :, : 4 * h] += df
            dx[:, :, 4 * h :] += db[::-1]
            dx *= mask[:, :, None]
            flat = dx.reshape(-1, 8 * h)
            by_path = np.zeros((len(used), 8 * h), np.float32)
            np.add.at(by_path, at.ravel(), flat)
            grad["path"], grad["text"], grad["bias"] = known.T @ by_path, numbers.reshape(-1, numbers.shape[2]).T @ flat, flat.sum(axis=0)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            scale = min(1.0, 1 / max(norm, 1e-9))
            slow = rate * (1 if step < 0.7 * steps else 0.2)
            for k, g in grad.items():
                g = g * scale
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.p[k] -= (slow * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
