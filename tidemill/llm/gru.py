"""A gated recurrent language model in numpy, with a class-factored softmax.

Words are numbered by frequency and fall into classes of neighbours, small
ones for frequent words and larger ones for rare words, so P(w) = P(class) *
P(word | class) costs little for most words.  Texts are laid end to end in
lanes.  A window of steps is worked on at once; the state goes on into the
next window, and starts anew where a text starts.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

HIDDEN = 16
END, OTHER = 0, 1
#: Words of the smallest vocabulary, END and OTHER among them, and of its smallest class.
LEAST_WORDS, LEAST_CLASS = 1024, 8
#: Steps that a gradient goes back, and lanes.
WINDOW, LANES = 16, 512
SCORE_WINDOW, SCORE_LANES = 32, 512
#: In training texts of more words are laid in several lanes; a part that goes on a text first reads so many words before it.
TRAIN_WORDS, BURN = 1024, 32


@dataclass(frozen=True)
class Layout:
    """How many words there are, and where the classes start and end."""

    words: int
    bounds: tuple[int, ...]

    @property
    def shapes(self) -> dict[str, tuple[int, ...]]:
        classes = len(self.bounds) - 1
        return {"x": (self.words, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "cw": (HIDDEN, classes), "cb": (classes,), "mw": (self.words, HIDDEN), "mb": (self.words,)}

    def class_of(self, words: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))[words]


def layout(distinct: int) -> Layout:
    """The vocabulary grows as twice the square root of the distinct words, the number of classes as its root."""
    words = max(LEAST_WORDS, 1 << round(np.log2(max(1.0, 2 * distinct**0.5))))
    classes = max(32, int(words**0.5) // 2)
    low, high = 1.0, 2.0
    for _ in range(60):  # sizes grow by a factor from class to class
        grow = (low + high) / 2
        low, high = (grow, high) if LEAST_CLASS * (grow ** np.arange(classes)).sum() < words else (low, grow)
    bounds = np.minimum(words, np.concatenate(([0], np.cumsum(np.maximum(1, LEAST_CLASS * low ** np.arange(classes)).astype(int)))))
    bounds[-1] = words
    return Layout(words, tuple(bounds.tolist()))


def initial(counts: np.ndarray, own: Layout, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; the biases start at the words' frequencies."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * (0.3 if k == "x" else 0.2)).astype(np.float32) for k, s in own.shapes.items()}
    p["cw"] *= 0.1
    p["mw"] *= 0.1
    p["x"][:, HIDDEN : 2 * HIDDEN] += 0.5
    n = counts + 0.5
    p["cb"], p["mb"] = np.log(np.add.reduceat(n, own.bounds[:-1])).astype(np.float32), np.log(n).astype(np.float32)
    return p


@dataclass
class Runs:
    """Runs of words that are laid in lanes: where each begins, its words, the words read before it, and whether its text ends with it."""

    begin: np.ndarray
    size: np.ndarray
    burn: np.ndarray
    ends: np.ndarray
    text: np.ndarray


def whole(start: np.ndarray, docs: np.ndarray) -> Runs:
    size = np.diff(start)[docs]
    return Runs(start[:-1][docs], size, np.zeros(len(docs), np.int64), np.ones(len(docs), bool), docs)


def parts(start: np.ndarray, docs: np.ndarray) -> Runs:
    """The texts ``docs`` in parts of TRAIN_WORDS words at most, all of each text."""
    size = np.diff(start)[docs]
    count = np.maximum(1, -(-size // TRAIN_WORDS))
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = nth * TRAIN_WORDS
    return Runs(np.repeat(start[:-1][docs], count) + at, np.minimum(TRAIN_WORDS, np.repeat(size, count) - at), np.where(nth > 0, BURN, 0), nth == np.repeat(count, count) - 1, np.repeat(docs, count))


def lanes(words: np.ndarray, runs: Runs, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What each step is given, its target, its text (-1 beyond a lane's end, -2 where nothing is learned) and where runs begin: steps x lanes, long lanes first.

    A text is its words and then END; what comes before it counts as END.
    """
    size = runs.burn + runs.size + runs.ends
    total = int(size.sum())
    # more lanes than this would wait for the longest run
    n = int(np.clip(2 * total // max(1, int(size.max(initial=1))), 1, min(most, max(1, len(size)))))
    heap, held = [(0, k) for k in range(n)], [[] for _ in range(n)]
    for r in np.argsort(-size, kind="stable").tolist():
        load, k = heapq.heappop(heap)
        held[k].append(r)
        heapq.heappush(heap, (load + int(size[r]), k))
    length = np.array([sum(int(size[r]) for r in h) for h in held])
    by = np.argsort(-length, kind="stable")
    target = np.zeros((int(length.max(initial=0)), n), np.int32)
    given, text, begins = np.full(target.shape, END, np.int32), np.full(target.shape, -1, np.int32), np.zeros(target.shape, bool)
    for lane, k in enumerate(by.tolist()):
        at = 0
        for r in held[k]:
            burn = int(runs.burn[r])
            a, b = int(runs.begin[r]) - burn, int(runs.begin[r] + runs.size[r])
            target[at : at + b - a, lane] = words[a:b]
            given[at + 1 : at + b - a + 1, lane] = words[a:b][: len(target) - at - 1]
            if burn:
                given[at, lane] = words[a - 1]
            stop = at + int(size[r])
            text[at : at + burn, lane] = -2
            text[at + burn : stop, lane] = runs.text[r]
            given[stop : stop + 1, lane] = END
            begins[at, lane] = True
            at = stop
    return given, target, text, begins


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def steps(p: dict, given: np.ndarray, keep: np.ndarray, h: np.ndarray, trace: list | None) -> tuple[np.ndarray, np.ndarray]:
    """States after each step, and the last."""
    out = np.empty((*given.shape, HIDDEN), np.float32)
    for t in range(len(given)):
        h = h * keep[t]
        a, g = p["x"][given[t]], h @ p["u"]
        rz = _sigmoid(a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        r, z, gn = rz[:, :HIDDEN], rz[:, HIDDEN:], g[:, 2 * HIDDEN :]
        n = 2.0 * _sigmoid(2.0 * (a[:, 2 * HIDDEN :] + r * gn)) - 1.0
        if trace is not None:
            trace.append((h, r, z, gn, n))
        h = h + z * (n - h)
        out[t] = h
    return out, h


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials and their sums by row; a sum by product is faster than a reduction of short rows."""
    x = np.exp(np.minimum(x, 60.0))
    return x, x @ np.ones(x.shape[1], np.float32)


def output(p: dict, own: Layout, h: np.ndarray, target: np.ndarray, grads: dict | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log of each target's probability, and the gradient of minus their sum by ``h``."""
    n = np.arange(len(h))
    cls = own.class_of(target)
    q, total = _exp(h @ p["cw"] + p["cb"])
    logp = np.log(q[n, cls]) - np.log(total)
    dh = None
    if grads is not None:
        q /= total[:, None]
        q[n, cls] -= 1.0
        grads["cw"] += h.T @ q
        grads["cb"] += q.sum(0)
        dh = q @ p["cw"].T
    by = np.argsort(cls.astype(np.int16), kind="stable")
    cut = np.searchsorted(cls[by], np.arange(len(own.bounds)))
    mine, member = h[by], target[by]
    inner = np.empty(len(h), np.float32)
    back = np.empty_like(h) if grads is not None else None
    for c in range(len(own.bounds) - 1):
        s, w = slice(cut[c], cut[c + 1]), slice(own.bounds[c], own.bounds[c + 1])
        m = cut[c + 1] - cut[c]
        if not m:
            continue
        q, total = _exp(mine[s] @ p["mw"][w].T + p["mb"][w])
        k = n[:m]
        inner[s] = np.log(q[k, member[s] - w.start]) - np.log(total)
        if grads is not None:
            q /= total[:, None]
            q[k, member[s] - w.start] -= 1.0
            grads["mw"][w] += q.T @ mine[s]
            grads["mb"][w] += np.ones(m, np.float32) @ q
            back[s] = q @ p["mw"][w]
    logp[by] += inner
    if grads is not None:
        dh[by] += back
    return logp, dh


def windows(given: np.ndarray, target: np.ndarray, text: np.ndarray, begins: np.ndarray, size: int):
    """given, target, text and keep of each window, for the lanes that still go on."""
    for at in range(0, len(target), size):
        live = int((text[at] != -1).sum())
        s = np.s_[at : at + size, :live]
        yield given[s].astype(np.int64), target[s].astype(np.int64), text[s], (~begins[s]).astype(np.float32)[:, :, None]


def score(p: dict, own: Layout, words: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each whole text, its end included."""
    n_docs = len(start) - 1
    total = np.zeros(n_docs)
    h = None
    for given, target, text, keep in windows(*lanes(words, whole(start, np.arange(n_docs)), SCORE_LANES), SCORE_WINDOW):
        h = np.zeros((given.shape[1], HIDDEN), np.float32) if h is None else h[: given.shape[1]]
        out, h = steps(p, given, keep, h, None)
        live = text >= 0
        logp, _ = output(p, own, out[live], target[live], None)
        total += np.bincount(text[live], logp, minlength=n_docs)
    return total


class Trainer:
    """Adam over windows of truncated backpropagation."""

    def __init__(self, p: dict[str, np.ndarray], own: Layout, rate: float):
        self.own = own
        self.p, self.rate, self.t = {k: v.copy() for k, v in p.items()}, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        self.seen = 0

    def fit(self, words: np.ndarray, start: np.ndarray, docs: np.ndarray) -> None:
        if not len(docs):
            return
        h = None
        laid = lanes(words, parts(start, docs), LANES)
        for given, target, text, keep in windows(*laid, WINDOW):
            h = np.zeros((given.shape[1], HIDDEN), np.float32) if h is None else h[: given.shape[1]]
            h = self.window(given, target, text >= 0, keep, h)

    def window(self, given, target, live, keep, h):
        p, trace = self.p, []
        grads = {k: np.zeros_like(v) for k, v in p.items() if k != "x"}
        out, last = steps(p, given, keep, h, trace)
        _, dh = output(p, self.own, out[live], target[live], grads)
        n = int(live.sum())
        if not n:
            return last
        self.seen += n
        each = np.zeros_like(out)
        each[live] = dh / n
        for k in grads:
            grads[k] /= n
        da = np.empty((*given.shape, 3 * HIDDEN), np.float32)
        carry = np.zeros_like(last)
        for t in range(len(given) - 1, -1, -1):
            before, r, z, gn, new = trace[t]
            d = each[t] + carry
            dan = d * z * (1.0 - new * new)
            da[t, :, :HIDDEN] = dan * gn * r * (1.0 - r)
            da[t, :, HIDDEN : 2 * HIDDEN] = d * (new - before) * z * (1.0 - z)
            da[t, :, 2 * HIDDEN :] = dan
            dg = da[t].copy()
            dg[:, 2 * HIDDEN :] *= r
            grads["u"] += before.T @ dg
            carry = (d * (1.0 - z) + dg @ p["u"].T) * keep[t]
        flat, da = given.ravel(), da.reshape(-1, 3 * HIDDEN)
        by = np.argsort(flat, kind="stable")
        rows = flat[by]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        self.step(grads, rows[first], np.add.reduceat(da[by], first, axis=0))
        return last

    def step(self, grads: dict, rows: np.ndarray, row_grads: np.ndarray) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for k, g in [*grads.items(), ("x", row_grads)]:
            at = rows if k == "x" else slice(None)
            g = np.clip(g, -0.5, 0.5)
            m, v = self.m[k], self.v[k]
            m[at] = 0.9 * m[at] + 0.1 * g
            v[at] = 0.99 * v[at] + 0.01 * g * g
            self.p[k][at] -= (rate * m[at] / (np.sqrt(v[at]) + 1e-7)).astype(np.float32)


def flat(p: dict[str, np.ndarray], own: Layout) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in own.shapes]).astype(np.float32)


def shaped(values: np.ndarray, own: Layout) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in own.shapes.items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out
