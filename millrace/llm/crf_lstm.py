"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, windows, decoding."""

from __future__ import annotations

import functools
import random
from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
N_TAGS = len(TAGS)
EMBED, HIDDEN = 12, 20
WINDOW, STRIDE = 96, 48
EXAMPLES, EPOCHS, BATCH, RATE, SEED = 2000, 3, 48, 0.025, 7
#: A character's symbol: letters without case, one for digits, one for other letters, each of the rest of ASCII itself.
_ASCII = {c: k for k, c in enumerate(dict.fromkeys("abcdefghijklmnopqrstuvwxyz0 \n@.-_+()/:,%#&'\"=<>[]"))}
SYMBOLS = len(_ASCII) + 3
_TABLE = np.full(256, SYMBOLS - 2, np.int64)
for _b in range(128):
    _c = chr(_b).lower()
    _TABLE[_b] = _ASCII.get("0" if _c.isdigit() else " " if _c in "\t\r\x0b\x0c" else _c, SYMBOLS - 2)
PAD, FOREIGN = SYMBOLS - 1, SYMBOLS - 3


def encode(text: str) -> np.ndarray:
    """Symbols of a text, one for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _TABLE[np.minimum(points, 255)], FOREIGN).astype(np.int16)


def allowed() -> np.ndarray:
    """Transition scores that no training changes: I follows B or I of its own kind."""
    bad = np.zeros((N_TAGS, N_TAGS))
    for a, ta in enumerate(TAGS):
        for b, tb in enumerate(TAGS):
            if tb[0] == "I" and ta not in (f"B-{tb[2:]}", tb):
                bad[a, b] = -1e4
    return bad


ALLOWED = allowed()
START = np.array([-1e4 if t[0] == "I" else 0.0 for t in TAGS])


@dataclass
class Tagger:
    p: dict[str, np.ndarray]

    def emissions(self, x: np.ndarray, keep: bool = False):
        """Tag scores (n, w, tags) of windows of symbols (n, w)."""
        out, held = [], []
        for way in "fb":
            xs = x if way == "f" else x[:, ::-1]
            gates_in = (self.p["E"] @ self.p[f"W{way}"] + self.p[f"b{way}"])[xs]
            h = np.zeros((len(x), self.p[f"U{way}"].shape[0]), gates_in.dtype)
            c = np.zeros_like(h)
            hs, states = [], []
            d = h.shape[1]
            for t in range(x.shape[1]):
                z = gates_in[:, t] + h @ self.p[f"U{way}"]
                s = 1 / (1 + np.exp(-z[:, : 3 * d]))
                g = np.tanh(z[:, 3 * d :])
                before = (h, c)
                c = s[:, d : 2 * d] * c + s[:, :d] * g
                tc = np.tanh(c)
                h = s[:, 2 * d :] * tc
                hs.append(h)
                if keep:
                    states.append((*before, s, g, c, tc))
            hs = np.stack(hs, 1)
            out.append(hs if way == "f" else hs[:, ::-1])
            held.append((xs, states))
        both = np.concatenate(out, 2)
        scores = both @ self.p["V"] + self.p["v"]
        return (scores, both, held) if keep else scores

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Best tags (n, w) by Viterbi."""
        n, w, k = scores.shape
        move = (self.p["T"] + ALLOWED).astype(scores.dtype)
        best = scores[:, 0] + START.astype(scores.dtype)
        back = np.zeros((n, w, k), np.int8)
        for t in range(1, w):
            all_ = best[:, :, None] + move
            back[:, t] = all_.argmax(1)
            best = all_.max(1) + scores[:, t]
        tags = np.zeros((n, w), np.int64)
        tags[:, -1] = best.argmax(1)
        for t in range(w - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        return tags

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood of tags y, a mean over windows, and its gradient."""
        scores, both, held = self.emissions(x, keep=True)
        n, w, k = scores.shape
        move = self.p["T"] + ALLOWED
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        alpha[:, 0] = scores[:, 0] + START

        def sum_exp(a: np.ndarray, axis: int) -> np.ndarray:
            top = a.max(axis, keepdims=True)
            return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)

        for t in range(1, w):
            alpha[:, t] = sum_exp(alpha[:, t - 1, :, None] + move, 1) + scores[:, t]
        for t in range(w - 2, -1, -1):
            beta[:, t] = sum_exp(move + (beta[:, t + 1] + scores[:, t + 1])[:, None, :], 2)
        log_z = sum_exp(alpha[:, -1], 1)
        rows = np.arange(n)[:, None]
        path = scores[rows, np.arange(w), y].sum(1) + START[y[:, 0]] + move[y[:, :-1], y[:, 1:]].sum(1)
        grad_scores = np.exp(alpha + beta - log_z[:, None, None])
        grad_scores[rows, np.arange(w), y] -= 1
        pair = np.exp(alpha[:, :-1, :, None] + move + (beta + scores)[:, 1:, None, :] - log_z[:, None, None, None]).sum((0, 1))
        np.add.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        grad = {"T": pair * (ALLOWED == 0)}
        grad["V"] = both.reshape(-1, both.shape[2]).T @ grad_scores.reshape(-1, k)
        grad["v"] = grad_scores.sum((0, 1))
        d_both = grad_scores @ self.p["V"].T
        d = both.shape[2] // 2
        grad["E"] = np.zeros_like(self.p["E"])
        for way, (xs, states), dh_all in zip("fb", held, (d_both[:, :, :d], d_both[:, ::-1, d:]), strict=True):
            U = self.p[f"U{way}"]
            dh, dc = np.zeros((n, d)), np.zeros((n, d))
            dU = np.zeros_like(U)
            dz_all = np.zeros((n, w, 4 * d))
            for t in range(w - 1, -1, -1):
                h0, c0, s, g, _, tc = states[t]
                i, f, o = s[:, :d], s[:, d : 2 * d], s[:, 2 * d :]
                dh = dh + dh_all[:, t]
                dc = dc + dh * o * (1 - tc**2)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], 1)
                dz_all[:, t] = dz
                dU += h0.T @ dz
                dh, dc = dz @ U.T, dc * f
            by_symbol = np.zeros((SYMBOLS, 4 * d))
            np.add.at(by_symbol, xs.ravel(), dz_all.reshape(-1, 4 * d))
            grad[f"U{way}"], grad[f"b{way}"] = dU, dz_all.sum((0, 1))
            grad[f"W{way}"] = self.p["E"].T @ by_symbol
            grad["E"] += by_symbol @ self.p[f"W{way}"].T
        return float((log_z - path).mean()), {key: g / n for key, g in grad.items()}


def new_tagger(rng: np.random.Generator, embed: int = EMBED, hidden: int = HIDDEN) -> Tagger:
    p = {"E": rng.normal(0, 0.3, (SYMBOLS, embed)), "V": rng.normal(0, 0.2, (2 * hidden, N_TAGS)), "v": np.zeros(N_TAGS), "T": np.zeros((N_TAGS, N_TAGS))}
    for way in "fb":
        p[f"W{way}"] = rng.normal(0, embed**-0.5, (embed, 4 * hidden))
        p[f"U{way}"] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden))
        p[f"b{way}"] = np.zeros(4 * hidden)
        p[f"b{way}"][hidden : 2 * hidden] = 1
    return Tagger(p)


def labelled_examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts of about a window with their labelled spans: invented words, personal data in many shapes, and look-alikes without any."""
    r = random.Random(seed)
    syllables = "the of an er on ti in ed sh wh re nd ing ly ver sch ein keit lich ung eau que ment tion ción ado los é ü ß ñ".split()
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))

    def email() -> str:
        local = r.choice([name(), f"{name()}.{name()}", f"{name()}.{digits(2)}", f"{name()}_{digits(1)}", f"{name()}+{name()}", f"{name().title()}-{name()}"])
        at = r.choice(["@", "@", "@", " @ ", "[@]", "(@)"])
        return f"{local}{at}{r.choice([name(), f'mail{digits(1)}.{name()}', f'{name()}-{name()}'])}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'co.uk', 'io'])}"

    def ip() -> str:
        part = lambda: str(r.randint(0, 255))
        return r.choice([".", ".", ".", " . "]).join([part(), part(), part(), part()]) + r.choice(["", "", f":{digits(4)}"])

    def card() -> str:
        joint = r.choice(["", "", " ", "-"])
        return r.choice([joint.join(r.choice("3456") + digits(3) if k == 0 else digits(4) for k in range(4)), "3" + digits(14), digits(4) + " " + digits(6) + " " + digits(5)])

    def phone() -> str:
        return r.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}", f"+{digits(2)}{digits(9)}", f"0{digits(3)} {digits(6)}", f"+33 {digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"+{digits(2)}.{digits(3)}.{digits(3)}.{digits(3)}"])

    def decoy() -> str:
        return r.choice([f"19{digits(2)}", f"20{digits(2)}", f"{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(1)},{digits(3)}.{digits(2)}", f"20{digits(2)}-0{r.randint(1, 9)}-1{digits(1)}", f"1{digits(1)}:{digits(2)}:{digits(2)}", f"@{name()}", f"#{digits(3)}", f"{digits(2)}%", f"({digits(1)})", f"{digits(6)}", f"v{digits(1)}.{digits(1)}", f"{name()}.{name()}", "AKIA" + digits(3) + name().upper() + digits(2), f"+{digits(1)}", f"{digits(1)}+{digits(1)}", coded(), coded()])

    def coded() -> str:
        value = "".join(r.choice("0123456789abcdef") for _ in range(r.randint(12, 40)))
        return r.choice([f"password={value}", f'token = "{value}"', value, f"key: {value}"])

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        parts, spans, at = [], [], 0

        def put(s: str) -> None:
            nonlocal at
            parts.append(s)  # noqa: B023
            at += len(s)

        target = r.randint(30, WINDOW)
        while at < target:
            chance = r.random() * (0.25 if spans and spans[-1][2] == at - 1 else 1.0)
            if chance < 0.10:
                kind = r.choice(KINDS)
                value = makers[kind]()
                spans.append((kind, at, at + len(value)))
                put(value)
            elif chance < 0.22:
                put(decoy())
            else:
                put(word() if r.random() < 0.85 else word().title())
            put(r.choice([" ", " ", " ", " ", ", ", ". ", "\n", ": "]))
        out.append(("".join(parts), spans))
    return out


def tagged(examples: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.full((len(examples), WINDOW), PAD, np.int64), np.zeros((len(examples), WINDOW), np.int64)
    for k, (text, spans) in enumerate(examples):
        codes = encode(text)[:WINDOW]
        x[k, : len(codes)] = codes
        for kind, a, b in spans:
            if b <= WINDOW:
                y[k, a:b] = TAGS.index(f"I-{kind}")
                y[k, a] = TAGS.index(f"B-{kind}")
            else:
                x[k, a:] = PAD
    return x, y


def train(examples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = EPOCHS, seed: int = SEED) -> Tagger:
    """Adam over shuffled batches of windows."""
    rng = np.random.default_rng(seed)
    tagger = new_tagger(rng)
    x, y = tagged(examples)
    m = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    step, steps = 0, epochs * -(-len(x) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            pick = order[a : a + BATCH]
            _, grad = tagger.loss_and_gradient(x[pick], y[pick])
            step += 1
            rate = RATE * (1 - 0.9 * step / steps)
            size = np.sqrt(sum((g**2).sum() for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / max(size, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g**2
                tagger.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)
    return Tagger({k: v.astype(np.float32) for k, v in tagger.p.items()})


@functools.lru_cache(maxsize=1)
def trained() -> Tagger:
    """The tagger, trained once in the driver's process from labelled_examples()."""
    return train(labelled_examples())
