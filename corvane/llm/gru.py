"""A gated recurrent language model with a class-factored output, in numpy.

A word's probability is its class's probability times its share within the class. Documents are
laid end to end in lanes; the hidden state is carried from window to window until the next document
begins, gradients stop at a window's start.
"""

from __future__ import annotations

import heapq

import numpy as np

CLASSES, HIDDEN, WINDOW, LANES = 32, 16, 16, 512
#: Tokens of each lane that are laid out side by side at a time (a multiple of WINDOW).
SPAN = 64 * WINDOW
LN10 = float(np.log(10.0))


def shapes(vocab: int) -> dict[str, tuple[int, ...]]:
    """Parameters of a model over vocab words (a multiple of CLASSES)."""
    size = vocab // CLASSES
    return {"inputs": (vocab, 3 * HIDDEN), "gates": (HIDDEN, 2 * HIDDEN), "candidate": (HIDDEN, HIDDEN), "to_class": (HIDDEN, CLASSES), "class_bias": (CLASSES,), "to_word": (CLASSES, HIDDEN, size), "word_bias": (CLASSES, size)}


def start(vocab: int, counts: np.ndarray, seed: int = 5) -> np.ndarray:
    """First parameters: small random weights, and the words' own frequencies as biases."""
    rng = np.random.default_rng(seed)
    parts = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in shapes(vocab).items()}
    grid = counts.reshape(CLASSES, -1).astype(np.float64) + 0.5
    parts["class_bias"] = np.log(grid.sum(1) / grid.sum())
    parts["word_bias"] = np.log(grid / grid.sum(1, keepdims=True))
    return np.concatenate([parts[k].ravel() for k in shapes(vocab)]).astype(np.float32)


def views(flat: np.ndarray, vocab: int) -> dict[str, np.ndarray]:
    """The named parameters inside one flat vector."""
    out, at = {}, 0
    for name, shape in shapes(vocab).items():
        n = int(np.prod(shape))
        out[name], at = flat[at : at + n].reshape(shape), at + n
    return out


def lanes_of(docs: list[np.ndarray], most: int = LANES) -> list[list[int]]:
    """Documents dealt to lanes of about equal length, longest lane first."""
    n = max(1, min(most, len(docs)))
    heap = [(0, i) for i in range(n)]
    lanes: list[list[int]] = [[] for _ in range(n)]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        length, i = heapq.heappop(heap)
        lanes[i].append(d)
        heapq.heappush(heap, (length + len(docs[d]), i))
    return sorted(lanes, key=lambda lane: -sum(len(docs[d]) for d in lane))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _softmax_rows(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    x /= x.sum(1, keepdims=True)
    return x


def _side_by_side(lane_words, lane_owner, lane_begins, start: int, n: int):
    """Words (-1: none), owners and begins of the next SPAN tokens of the first n lanes, a column each."""
    words, owner, begins = np.full((SPAN, n), -1, np.int32), np.zeros((SPAN, n), np.int32), np.zeros((SPAN, n), bool)
    for i in range(n):
        part = lane_words[i][start : start + SPAN]
        words[: len(part), i], owner[: len(part), i] = part, lane_owner[i][start : start + SPAN]
        first, last = np.searchsorted(lane_begins[i], [start, start + SPAN])
        begins[lane_begins[i][first:last] - start, i] = True
    return words, owner, begins


def run_lanes(flat: np.ndarray, vocab: int, docs: list[np.ndarray], end: int, update=None) -> np.ndarray:
    """The natural log probability of each document; with update(gradient, tokens), training goes along.

    docs: word numbers; each begins with no state, whether or not the one before it closes with end. update
    gets each window's summed gradient. Memory goes with the tokens of all documents together: a very
    long one lies in a lane of its own and takes no room in the others.
    """
    p = views(flat, vocab)
    size = vocab // CLASSES
    lanes = lanes_of(docs)
    lengths = np.array([sum(len(docs[d]) for d in lane) for lane in lanes])
    total, longest = len(lanes), int(lengths.max())
    # Each lane's words, whose they are, and where documents begin: as much as there is, however unlike the lanes are.
    lane_words = [np.concatenate([docs[d] for d in lane]).astype(np.int32) for lane in lanes]
    lane_owner = [np.repeat(np.array(lane, np.int32), [len(docs[d]) for d in lane]) for lane in lanes]
    lane_begins = [np.cumsum([0] + [len(docs[d]) for d in lane])[:-1] for lane in lanes]
    score = np.zeros(len(docs))
    hidden, before = np.zeros((total, HIDDEN), np.float32), np.full(total, end, np.int32)
    grad = np.zeros_like(flat) if update else None
    g = views(grad, vocab) if update else None
    for t0 in range(0, longest, WINDOW):
        if t0 % SPAN == 0:
            words, owner, begins = _side_by_side(lane_words, lane_owner, lane_begins, t0, int((lengths > t0).sum()))
        n = int((lengths > t0).sum())
        T, s0 = min(WINDOW, longest - t0), t0 % SPAN
        w = words[s0 : s0 + T, :n]
        previous = np.concatenate([before[None, :n], w[:-1]])
        previous = np.where((previous < 0) | begins[s0 : s0 + T, :n], end, previous)
        fresh = previous == end
        x = p["inputs"][previous]
        h = hidden[:n]
        H0, Z, R, C, OUT = (np.empty((T, n, HIDDEN), np.float32) for _ in range(5))
        for t in range(T):
            h = np.where(fresh[t][:, None], np.float32(0), h)
            zr = _sigmoid(x[t, :, : 2 * HIDDEN] + h @ p["gates"])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[t, :, 2 * HIDDEN :] + (r * h) @ p["candidate"])
            H0[t], Z[t], R[t], C[t] = h, z, r, c
            h = c + z * (h - c)
            OUT[t] = h
        hidden[:n], before[:n] = h, w[-1]
        real = w.ravel() >= 0
        flat_words = w.ravel()[real]
        out = OUT.reshape(-1, HIDDEN)[real]
        order = np.argsort(flat_words // size, kind="stable")
        flat_words, out = flat_words[order], out[order]
        kinds, inner = flat_words // size, flat_words % size
        rows = np.arange(len(flat_words))
        prob = _softmax_rows(out @ p["to_class"] + p["class_bias"])
        logp = np.log(prob[rows, kinds] + 1e-30)
        d_out = None
        if update:
            grad[:] = 0
            prob[rows, kinds] -= 1
            d_out = prob @ p["to_class"].T
            g["to_class"][:] = out.T @ prob
            g["class_bias"][:] = prob.sum(0)
        cuts = np.searchsorted(kinds, np.arange(CLASSES + 1))
        for k in range(CLASSES):
            a, b = cuts[k], cuts[k + 1]
            if a == b:
                continue
            inside = _softmax_rows(out[a:b] @ p["to_word"][k] + p["word_bias"][k])
            at = rows[: b - a]
            logp[a:b] += np.log(inside[at, inner[a:b]] + 1e-30)
            if update:
                inside[at, inner[a:b]] -= 1
                d_out[a:b] += inside @ p["to_word"][k].T
                g["to_word"][k] = out[a:b].T @ inside
                g["word_bias"][k] = inside.sum(0)
        score += np.bincount(owner[s0 : s0 + T, :n].ravel()[real][order], logp, len(docs))
        if not update:
            continue
        dOUT = np.zeros((T * n, HIDDEN), np.float32)
        dOUT[np.flatnonzero(real)[order]] = d_out
        dOUT = dOUT.reshape(T, n, HIDDEN)
        dX = np.empty((T, n, 3 * HIDDEN), np.float32)
        carry = np.zeros((n, HIDDEN), np.float32)
        for t in range(T - 1, -1, -1):
            dh = dOUT[t] + carry
            z, r, c, h0 = Z[t], R[t], C[t], H0[t]
            dc = dh * (1 - z) * (1 - c * c)
            drh = dc @ p["candidate"].T
            dz, dr = dh * (h0 - c) * z * (1 - z), drh * h0 * r * (1 - r)
            dX[t, :, :HIDDEN], dX[t, :, HIDDEN : 2 * HIDDEN], dX[t, :, 2 * HIDDEN :] = dz, dr, dc
            carry = dh * z + drh * r + dX[t, :, : 2 * HIDDEN] @ p["gates"].T
            carry[fresh[t]] = 0
        flat_dx = dX.reshape(-1, 3 * HIDDEN)
        h_in = H0.reshape(-1, HIDDEN)
        g["gates"][:] = h_in.T @ flat_dx[:, : 2 * HIDDEN]
        g["candidate"][:] = (R.reshape(-1, HIDDEN) * h_in).T @ flat_dx[:, 2 * HIDDEN :]
        ids = previous.ravel()
        by_id = np.argsort(ids, kind="stable")
        sorted_ids = ids[by_id]
        first = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
        g["inputs"][sorted_ids[first]] = np.add.reduceat(flat_dx[by_id], first, axis=0)
        update(grad, len(flat_words))
    return score


class Adam:
    """Steps along mean gradients scaled by their running size, one for at least BATCH tokens and one for the last ones."""

    BATCH = 4096

    def __init__(self, flat: np.ndarray, rate: float):
        self.flat, self.rate, self.n, self.tokens = flat, rate, 0, 0
        self.held, self.mean, self.square = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)

    def __call__(self, grad: np.ndarray, tokens: int) -> None:
        self.held += grad
        self.tokens += tokens
        if self.tokens >= self.BATCH:
            self.flush()

    def flush(self) -> None:
        """The step for what is held, if anything is."""
        if not self.tokens:
            return
        grad = self.held / self.tokens
        norm = float(np.sqrt((grad * grad).sum()))
        if norm > 1:
            grad /= norm
        self.n += 1
        self.mean += 0.1 * (grad - self.mean)
        self.square += 0.01 * (grad * grad - self.square)
        self.flat -= self.rate * (self.mean / (1 - 0.9**self.n)) / (np.sqrt(self.square / (1 - 0.99**self.n)) + 1e-8)
        self.held[:], self.tokens = 0, 0
