"""A gated recurrent network over word ids with a class-factored softmax, in numpy."""

from __future__ import annotations

import numpy as np

HIDDEN, WINDOW, RATE = 32, 32, 0.06
#: Softmaxes over the classes are of so many words at a time, and over words of so many numbers, which a core's cache holds.
ROWS, CELLS = 512, 65_536
#: Logits within these bounds are raised as they are, others less the greatest of their softmax.
SAFE = 60.0
#: Descents of so many numbers at a time; what occurs more often than OFTEN in a window is summed as a run.
STEP, OFTEN = 32_768, 4


def word_classes(counts: np.ndarray, classes: int) -> np.ndarray:
    """The class of each word id, ids being in order of falling counts: classes of like sums of square roots."""
    share = np.cumsum(np.sqrt(counts + 1.0))
    return np.unique(np.minimum((share / share[-1] * classes).astype(np.int64), classes - 1), return_inverse=True)[1]


def _descend(p: np.ndarray, seen: np.ndarray, v: np.ndarray) -> None:
    """A step of p against the gradient v, by the sums of squares (above 0) that v is added to; all in place."""
    p, seen, v = p.reshape(-1), seen.reshape(-1), v.reshape(-1)
    room = np.empty(min(STEP, len(p)), p.dtype)
    for i in range(0, len(p), STEP):
        some, to = v[i : i + STEP], slice(i, i + STEP)
        step = room[: len(some)]
        np.multiply(some, some, out=step)
        seen[to] += step
        np.sqrt(seen[to], out=step)
        np.divide(some, step, out=step)
        step *= RATE
        p[to] -= step


def _unsafe(logits: np.ndarray) -> bool:
    return bool(logits.max() > SAFE or logits.min() < -SAFE)


def _sums(d: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words, and for each the sum of the rows of d that are its own."""
    order = np.argsort(words.astype(np.min_scalar_type(int(words.max()))), kind="stable")
    ranked = words[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    often = np.diff(np.r_[first, len(words)])
    by = np.argsort(-often, kind="stable")
    first, often = first[by], often[by]
    out = d.take(order[first], axis=0)
    if runs := int(np.searchsorted(-often, -OFTEN)):
        start = np.cumsum(often[:runs]) - often[:runs]
        at = np.repeat(first[:runs] - start, often[:runs])
        out[:runs] = np.add.reduceat(d.take(order[at + np.arange(len(at))], axis=0), start, axis=0)
    for r in range(1, OFTEN):
        k = int(np.searchsorted(-often, -r))
        out[runs:k] += d.take(order[first[runs:k] + r], axis=0)
    return ranked[first], out


class Gru:
    """P(word | past) = P(class | state) * P(word | class, state). Word ids are grouped by class in rising order.

    p: X (a row of gate inputs per word), U, u (state to gates, by gate), C, c (state to classes), W (state to words, the last column without it).
    The gates are z, r and the new part.
    """

    def __init__(self, counts: np.ndarray, classes: int, seed: int = 5):
        self.cls = word_classes(counts, classes)
        classes = int(self.cls[-1]) + 1
        self.first = np.searchsorted(self.cls, np.arange(classes + 1))
        r, h, v = np.random.default_rng(seed), HIDDEN, len(counts)
        share = (counts + 1.0) / (counts + 1.0).sum()
        of_class = np.add.reduceat(share, self.first[:-1])
        small = lambda *n: (r.standard_normal(n) * 0.1).astype(np.float32)
        # Before any training this is the unigram model of the counts.
        self.p = {
            "X": small(v, 3 * h), "U": np.ascontiguousarray(small(h, 3, h).transpose(1, 0, 2)), "u": np.zeros((3, 1, h), np.float32),
            "C": np.zeros((h, classes), np.float32), "c": np.log(of_class).astype(np.float32),
            "W": np.zeros((v, h + 1), np.float32),
        }
        self.p["W"][:, h] = np.log(share / of_class[self.cls])

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """The gates' inputs (step, gate, stream, state) of words x with the constants, z and r negated; the new part's constant goes with the state."""
        rows = self.p["X"].take(x.ravel(), axis=0).reshape(*x.shape, 3, HIDDEN).transpose(0, 2, 1, 3)
        a = np.empty(rows.shape, rows.dtype)
        np.subtract(-self.p["u"][:2], rows[:, :2], out=a[:, :2])
        a[:, 2] = rows[:, 2]
        return a

    def _gates(self, a: np.ndarray, h: np.ndarray, b: np.ndarray, zr: np.ndarray, new: np.ndarray, after: np.ndarray) -> None:
        """The next states from inputs a and states h: fills b (what the state adds, by gate), z and r, the new part, and after."""
        np.matmul(h, self.p["U"], out=b)
        np.subtract(a[:2], b[:2], out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        of_new = b[2]
        of_new += self.p["u"][2]
        np.multiply(zr[1], of_new, out=new)
        new += a[2]
        np.tanh(new, out=new)
        np.subtract(h, new, out=after)
        after *= zr[0]
        after += new

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple:
        """The gates and the next state, from words x and states h."""
        a, new, after = self.inputs(x[None])[0], np.empty_like(h), np.empty_like(h)
        b, zr = np.empty_like(a), np.empty_like(a[:2])
        self._gates(a, h, b, zr, new, after)
        return zr[0], zr[1], new, b[2], after

    def word_logs(self, h: np.ndarray, y: np.ndarray, seen: dict[str, np.ndarray] | None = None, of: int | None = None) -> tuple:
        """Natural logs of P(y | h). If learning (see learn), W descends, and the loss's gradients for C, c and h are given too."""
        p, n, own, logs, g = self.p, len(y), self.cls[y], np.empty(len(y)), None
        of = of or n
        order = np.argsort(own.astype(np.int16), kind="stable")
        own, y, state = own[order], y[order], np.ones((n, HIDDEN + 1), h.dtype)
        h = h.take(order, axis=0)
        state[:, :HIDDEN] = h
        if learn := seen is not None:
            g, back, past = {"C": np.zeros_like(p["C"]), "c": np.zeros_like(p["c"])}, np.empty_like(h), np.empty_like(state)
            turned = np.ascontiguousarray(p["C"].T)
        ones, places = np.ones(len(p["c"]), h.dtype), np.arange(ROWS)
        for i in range(0, n, ROWS):
            some, to = h[i : i + ROWS], slice(i, i + ROWS)
            pick = (places[: len(some)], own[to])
            e = some @ p["C"]
            e += p["c"]
            if _unsafe(e):
                e -= e.max(1, keepdims=True)
            logs[to] = e[pick]
            np.exp(e, out=e)
            total = e @ ones
            logs[to] -= np.log(total)
            if learn:
                e[pick] -= total
                scale = 1 / (total * of)
                g["C"] += (some * scale[:, None]).T @ e
                g["c"] += scale @ e
                np.matmul(e, turned, out=back[to])
                back[to] *= scale[:, None]
        cuts, wide = np.searchsorted(own, np.arange(len(self.first))), np.diff(self.first)
        ends, met = np.cumsum(np.diff(cuts) * wide), np.flatnonzero(np.diff(cuts))
        width = wide[own]
        column = y - self.first[own]
        cuts, first = cuts.tolist(), self.first.tolist()
        for ks in np.split(met, np.flatnonzero(np.diff(ends[met] // CELLS)) + 1) if n else ():
            i, j, a, b = cuts[ks[0]], cuts[ks[-1] + 1], first[ks[0]], first[ks[-1] + 1]
            begin = np.cumsum(width[i:j])
            e, at, spans, w = np.empty(int(begin[-1]), h.dtype), 0, [], p["W"][a:b]
            begin -= width[i:j]
            for k in ks.tolist():
                rows, words = slice(cuts[k], cuts[k + 1]), slice(first[k] - a, first[k + 1] - a)
                to = at + (cuts[k + 1] - cuts[k]) * (first[k + 1] - first[k])
                x = e[at:to].reshape(cuts[k + 1] - cuts[k], -1)
                np.matmul(state[rows], w[words].T, out=x)
                spans.append((x, rows, words))
                at = to
            if _unsafe(e):
                e -= np.repeat(np.maximum.reduceat(e, begin), width[i:j])
            pick = begin + column[i:j]
            logs[i:j] += e[pick]
            np.exp(e, out=e)
            total = np.add.reduceat(e, begin)
            logs[i:j] -= np.log(total)
            if learn:
                e[pick] -= total
                scale = (1 / (total * of))[:, None]
                state[i:j] *= scale
                v = np.empty_like(w) if len(spans) == ks[-1] + 1 - ks[0] else np.zeros_like(w)
                for x, rows, words in spans:
                    np.matmul(x.T, state[rows], out=v[words])
                    np.matmul(x, w[words], out=past[rows])
                past[i:j] *= scale
                _descend(w, seen["W"][a:b], v)
        out = np.empty(n)
        out[order] = logs
        if learn:
            back += past[:, :HIDDEN]
            g["h"] = np.empty_like(back)
            g["h"][order] = back
        return out, g

    def learn(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray, seen: dict[str, np.ndarray], of: int | None = None) -> tuple[np.ndarray, float]:
        """One window of truncated backpropagation: words x, next words y, where a text is fresh, all (steps, streams).

        h: the states carried in; seen: sums of squared gradients, for the step sizes; of: what the sum of the words' losses is
        divided by, so many as there are by default. Gives the last states and the mean loss.
        Each gate's numbers lie together, a row being a stream's state.
        """
        p, n, (steps, streams) = self.p, HIDDEN, x.shape
        keep, breaks, words = (~fresh).astype(h.dtype)[:, :, None], fresh.any(1).tolist(), x.ravel()
        a = self.inputs(x)
        b, zr = np.empty_like(a), np.empty((steps, 2, streams, n), a.dtype)
        past, new, after = (np.empty((steps, streams, n), a.dtype) for _ in range(3))
        state = h
        for at, before, bt, gates, c, nxt, k, broken in zip(a, past, b, zr, new, after, keep, breaks, strict=True):
            if broken:
                np.multiply(state, k, out=before)
            else:
                before[:] = state
            self._gates(at, before, bt, gates, c, nxt)
            state = nxt
        logs, grad = self.word_logs(after.reshape(-1, n), y.ravel(), seen, of)
        dh = grad.pop("h").reshape(steps, streams, n)
        # What the gradient of a state is multiplied by for those of z, r and the new part, as it meets U.
        z, r, by = zr[:, 0], zr[:, 1], a
        rest, of_new = 1 - z, new * new
        np.subtract(1, of_new, out=of_new)
        of_new *= rest
        rest *= z
        np.subtract(past, new, out=by[:, 0])
        by[:, 0] *= rest
        np.multiply(of_new, r, out=by[:, 2])
        np.subtract(1, r, out=by[:, 1])
        by[:, 1] *= b[:, 2]
        by[:, 1] *= by[:, 2]
        turned, parts, d = np.ascontiguousarray(p["U"].transpose(0, 2, 1)), np.empty_like(a[0]), np.zeros_like(h)
        for dt, some, zt, k, broken in zip(dh[::-1], by[::-1], z[::-1], keep[::-1], breaks[::-1], strict=True):
            dt += d
            some *= dt
            np.matmul(some, turned, out=parts)
            np.multiply(dt, zt, out=d)
            for part in parts:
                d += part
            if broken:
                d *= k
        rows_of = np.ascontiguousarray(by.transpose(0, 2, 1, 3)).reshape(-1, 3 * n)
        grad["U"] = np.ascontiguousarray((past.reshape(-1, n).T @ rows_of).reshape(n, 3, n).transpose(1, 0, 2))
        grad["u"] = (np.ones(len(rows_of), rows_of.dtype) @ rows_of).reshape(3, 1, n)
        np.multiply(dh, of_new, out=rows_of.reshape(steps, streams, 3, n)[:, :, 2])
        for k, v in grad.items():
            _descend(p[k], seen[k], v)
        rows, v = _sums(rows_of, words)
        at, sums = p["X"].take(rows, axis=0), seen["X"].take(rows, axis=0)
        _descend(at, sums, v)
        p["X"][rows], seen["X"][rows] = at, sums
        return after[-1], -float(logs.mean())

    def score(self, texts: list[np.ndarray], start: int) -> np.ndarray:
        """Natural log of each whole text's probability; states are carried from window to window.

        Texts should be of like lengths: they advance together, the longest first, and drop out as they end.
        """
        n = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-n, kind="stable")
        out, total, inputs, dtype = np.zeros(len(texts)), n[order], self.p["X"].copy(), self.p["X"].dtype
        inputs[:, : 2 * HIDDEN] += self.p["u"][:2].ravel()
        np.negative(inputs[:, : 2 * HIDDEN], out=inputs[:, : 2 * HIDDEN])
        h, last = np.zeros((len(texts), HIDDEN), dtype), np.full(len(texts), start)
        a, b = np.empty((len(texts), 3, HIDDEN), dtype), np.empty((3, len(texts), HIDDEN), dtype)
        zr, new, by_gate = np.empty_like(b[:2]), np.empty_like(h), a.transpose(1, 0, 2)
        for at in range(0, int(n.max(initial=0)), WINDOW):
            live = int(np.searchsorted(-total, -at, side="left"))
            sizes = np.minimum(total[:live] - at, WINDOW)
            window = np.full((WINDOW, live), -1, np.int64)
            window.T[np.arange(WINDOW) < sizes[:, None]] = np.concatenate([texts[i][at : at + WINDOW] for i in order[:live]])
            counts = np.searchsorted(-sizes, -np.arange(WINDOW), side="left")
            states, ends = np.empty((int(sizes.sum()), HIDDEN), dtype), np.cumsum(counts).tolist()
            for t, (end, m) in enumerate(zip(ends, counts.tolist(), strict=True)):
                if not m:
                    break
                np.take(inputs, last[:m], axis=0, out=a[:m].reshape(m, -1), mode="clip")
                self._gates(by_gate[:, :m], h[:m], b[:, :m], zr[:, :m], new[:m], states[end - m : end])
                h[:m], last[:m] = states[end - m : end], window[t, :m]
            inside = np.arange(live) < counts[:, None]
            logs, _ = self.word_logs(states, window[inside])
            out[:live] += np.bincount(np.nonzero(inside)[1], logs, live)
        back = np.zeros(len(texts))
        back[order] = out
        return back
