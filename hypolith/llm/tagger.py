"""A character tagger in numpy: a bidirectional LSTM whose scores a linear chain (CRF) decodes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Tags of characters: outside, and begin and inside of each kind.
KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
#: Characters of a window, its step, windows at a time, cells of each direction.
WINDOW, STEP, BATCH, CELLS = 48, 24, 2048, 20
_ALONE = "0@.,;:!?()[]{}<>+-_=/\\|\"'#%&*$~^` \nabcdefghijklmnopqrstuvwxyz"
#: Classes of characters: those of _ALONE (all digits as 0, letters A-Z as small ones), other letters, and all others.
_LETTER, _OTHER, _PAD = len(_ALONE), len(_ALONE) + 1, len(_ALONE) + 2
CLASSES = _PAD + 1
_CLASS = np.full(128, _OTHER, np.int16)
for _c in range(128):
    _x = "0" if chr(_c).isdigit() else "\n" if chr(_c) in "\t\r\v\f" else chr(_c).lower()
    _CLASS[_c] = _ALONE.find(_x) if _x in _ALONE else _OTHER


def classes(text: str) -> np.ndarray:
    """A class for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CLASS[np.minimum(points, 127)], np.where(points < 0x2000, _LETTER, _OTHER)).astype(np.int16)


def _allowed() -> np.ndarray:
    """Which tag may follow which: an inside tag only the begin or inside of its own kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


ALLOWED = _allowed()


class Tagger:
    """Weights by name in `w`: x and h (inputs and states to the gates of each direction), b, out, bias, next (from tag to tag)."""

    def __init__(self, seed: int = 12, cells: int = CELLS):
        r = np.random.default_rng(seed)
        self.cells = cells
        draw = lambda *n, s=0.1: (r.standard_normal(n) * s).astype(np.float32)
        self.w = {"out": draw(2 * cells, TAGS), "bias": np.eye(1, TAGS, dtype=np.float32)[0] * 2, "next": draw(TAGS, TAGS)}
        for d in "fb":
            self.w |= {f"x{d}": draw(CLASSES, 4 * cells, s=0.3), f"h{d}": draw(cells, 4 * cells, s=0.2), f"b{d}": np.zeros(4 * cells, np.float32)}
            self.w[f"b{d}"][cells : 2 * cells] = 1  # remembers at first

    def _run(self, codes: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States [time, row, cell] of one direction, and what its gradient needs."""
        n, t, k = len(codes), codes.shape[1], self.cells
        wx, wh, b = self.w[f"x{d}"] + self.w[f"b{d}"], self.w[f"h{d}"], None
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        out, tape = np.empty((t, n, k), np.float32), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = wx[codes[:, i]]
            z += h @ wh
            z[:, : 3 * k] *= 0.5
            np.tanh(z, out=z)
            z[:, : 3 * k] *= 0.5
            z[:, : 3 * k] += 0.5  # the gates in, forget and out; then the candidate
            before, last = c, h
            c = z[:, k : 2 * k] * c + z[:, :k] * z[:, 3 * k :]
            s = np.tanh(c)
            h = z[:, 2 * k : 3 * k] * s
            out[i] = h
            if keep:
                tape.append((i, z, before, last, s))
        return out, tape

    def _back(self, codes: np.ndarray, d: str, tape: list, gradient: np.ndarray, g: dict) -> None:
        k, n = self.cells, len(codes)
        wh = self.w[f"h{d}"]
        dh, dc = np.zeros((n, k), wh.dtype), np.zeros((n, k), wh.dtype)
        slopes = np.empty((len(tape), n, 4 * k), wh.dtype)
        for j, (i, z, before, _, s) in reversed(list(enumerate(tape))):
            a, f, o, c = (z[:, x * k : (x + 1) * k] for x in range(4))
            dh = dh + gradient[i]
            dc = dc + dh * o * (1 - s * s)
            slopes[j] = np.hstack([dc * c * a * (1 - a), dc * before * f * (1 - f), dh * s * o * (1 - o), dc * a * (1 - c * c)])
            dh, dc = slopes[j] @ wh.T, dc * f
        flat = slopes.reshape(-1, 4 * k)
        seen = np.concatenate([codes[:, x[0]] for x in tape])[:, None] == np.arange(CLASSES)
        g[f"x{d}"], g[f"h{d}"], g[f"b{d}"] = seen.T.astype(wh.dtype) @ flat, np.concatenate([x[3] for x in tape]).T @ flat, flat.sum(0)

    def _chain(self, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By forward and backward sums over emit [time, row, tag]: the chance of each tag, expected steps from tag to tag, and
        the log of the sum over all sequences."""
        t, n, k = emit.shape
        top = emit.max(2, keepdims=True)
        e = np.exp(emit - top)
        step = np.where(ALLOWED, np.exp(self.w["next"]), 0).astype(np.float32)
        ahead, after, log = np.empty_like(e), np.ones_like(e), top.sum((0, 2))
        for i in range(t):
            x = e[i] if i == 0 else e[i] * (ahead[i - 1] @ step)  # a window may begin inside a span
            size = x.sum(1, keepdims=True)
            ahead[i] = x / size
            log = log + np.log(size[:, 0])
        for i in range(t - 2, -1, -1):
            x = (e[i + 1] * after[i + 1]) @ step.T
            after[i] = x / x.sum(1, keepdims=True)
        chance = ahead * after
        chance /= chance.sum(2, keepdims=True)
        steps = np.zeros((k, k), np.float32)
        for i in range(t - 1):
            right = e[i + 1] * after[i + 1]
            size = ((ahead[i] @ step) * right).sum(1, keepdims=True)
            steps += (ahead[i] / size).T @ right * step
        return chance, steps, log

    def emitted(self, codes: np.ndarray) -> np.ndarray:
        k = self.cells
        return self._run(codes, "f", False)[0] @ self.w["out"][:k] + self._run(codes, "b", False)[0] @ self.w["out"][k:] + self.w["bias"]

    def loss(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log chance of the tags of each window, and its gradient."""
        (n, t), k = codes.shape, self.cells
        f, tape_f = self._run(codes, "f", True)
        b, tape_b = self._run(codes, "b", True)
        both = np.concatenate([f, b], 2)
        emit = both @ self.w["out"] + self.w["bias"]
        chance, steps, log = self._chain(emit)
        want = np.zeros_like(emit)
        np.put_along_axis(want, tags.T[:, :, None], 1, 2)
        taken = np.zeros((TAGS, TAGS), np.float32)
        np.add.at(taken, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        loss = (log.sum() - (emit * want).sum() - (taken * self.w["next"]).sum()) / n
        d = (chance - want) / n
        g = {"out": np.einsum("tnk,tnc->kc", both, d), "bias": d.sum((0, 1)), "next": np.where(ALLOWED, (steps - taken) / n, 0)}
        back = d @ self.w["out"].T
        self._back(codes, "f", tape_f, back[:, :, :k], g)
        self._back(codes, "b", tape_b, back[:, :, k:], g)
        return float(loss), g

    def fit(self, labelled: Sequence[tuple[str, list[tuple[str, int, int]]]], steps: int, batch: int = 16, rate: float = 0.05, seed: int = 5) -> Tagger:
        """Adaptive steps over windows that are drawn from labelled texts, (text, [(kind, start, end)])."""
        r = np.random.default_rng(seed)
        codes = [classes(text) for text, _ in labelled]
        tags = []
        for (_, spans), x in zip(labelled, codes, strict=True):
            y = np.zeros(len(x), np.int64)
            for kind, start, end in spans:
                y[start] = 1 + 2 * KINDS.index(kind)
                y[start + 1 : end] = 2 + 2 * KINDS.index(kind)
            tags.append(y)
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for i in range(steps):
            cs, ts = np.full((batch, WINDOW), _PAD, np.int16), np.zeros((batch, WINDOW), np.int64)
            for row, j in enumerate(r.integers(0, len(codes), batch)):
                at = int(r.integers(-8, max(1, len(codes[j]) - WINDOW + 8)))
                lo, hi = max(0, at), min(len(codes[j]), at + WINDOW)
                cs[row, lo - at : hi - at], ts[row, lo - at : hi - at] = codes[j][lo:hi], tags[j][lo:hi]
            _, g = self.loss(cs, ts)
            pace = rate * min(1.0, (i + 1) / 20) * (1 - i / steps) ** 0.7
            for k, x in g.items():
                x = np.clip(x, -1, 1)
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.01 * (x * x - v[k])
                self.w[k] -= (pace * (m[k] / (1 - 0.9 ** (i + 1))) / (np.sqrt(v[k] / (1 - 0.99 ** (i + 1))) + 1e-6)).astype(np.float32)
        return self

    def chances(self, zones: Sequence[np.ndarray]) -> list[np.ndarray]:
        """The chance of each tag at each place of each zone: that of all windows over the place, each decoded by its own chain,
        weighted by how far the place is from the window's ends."""
        out = [np.zeros((len(z), TAGS), np.float32) for z in zones]
        at = [(i, s) for i, z in enumerate(zones) for s in range(0, max(1, len(z) - STEP), STEP)]
        weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
        for lo in range(0, len(at), BATCH):
            part = at[lo : lo + BATCH]
            codes = np.full((len(part), WINDOW), _PAD, np.int16)
            for row, (i, s) in enumerate(part):
                x = zones[i][s : s + WINDOW]
                codes[row, : len(x)] = x
            chance = self._chain(self.emitted(codes))[0]
            for row, (i, s) in enumerate(part):
                x = out[i][s : s + WINDOW]
                x += chance[: len(x), row] * weight[: len(x)]
        for x in out:
            x /= x.sum(1, keepdims=True)
        return out


def best(chances: list[np.ndarray]) -> list[np.ndarray]:
    """Of each zone the sequence of tags with the largest product of chances in which only allowed tags follow each other."""
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(chances)
    order = sorted(range(len(chances)), key=lambda i: -len(chances[i]))
    bar = np.where(ALLOWED, 0, -1e9).astype(np.float32)
    for lo in range(0, len(order), 512):  # of like lengths
        part = [i for i in order[lo : lo + 512] if len(chances[i])]
        if not part:
            continue
        t = len(chances[part[0]])
        score = np.zeros((t, len(part), TAGS), np.float32)
        score[:, :, 1:] = -1e9  # beyond a zone's end everything is outside
        for row, i in enumerate(part):
            score[: len(chances[i]), row] = np.log(chances[i] + 1e-12)
        came = np.zeros((t, len(part), TAGS), np.int8)
        s = score[0] + bar[0]
        for k in range(1, t):
            way = s[:, :, None] + bar
            came[k] = way.argmax(1)
            s = np.take_along_axis(way, came[k][:, None, :].astype(np.int64), 1)[:, 0] + score[k]
            s -= s.max(1, keepdims=True)
        tag = s.argmax(1)
        path = np.zeros((t, len(part)), np.int8)
        for k in range(t - 1, -1, -1):
            path[k] = tag
            tag = came[k][np.arange(len(part)), tag]
        for row, i in enumerate(part):
            out[i] = path[: len(chances[i]), row]
    return out


def spans(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each begin tag and the inside tags after it."""
    found = []
    for i in np.flatnonzero(tags % 2 == 1):
        end = i + 1
        while end < len(tags) and tags[end] == tags[i] + 1:
            end += 1
        found.append((KINDS[int(tags[i]) // 2], int(i), int(end)))
    return found
