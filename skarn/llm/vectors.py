"""A subword title encoder trained by contrast, and inverted-file search over its vectors."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from skarn.llm.models import plain

#: Size of the feature table and of the vectors.
BUCKETS, DIMENSIONS = 1 << 15, 64
#: Initial size of number features beside that of letters: an unseen number must outweigh unseen words.
NUMBER_SCALE = 2.0
_TOKEN = re.compile(r"\d+|[^\W\d_]+")


def features(text: str) -> list[int]:
    """Hashed words and letter trigrams of a title (lower half of the table), its numbers and their digit pairs (upper half)."""
    half = BUCKETS // 2
    out = set()
    for token in _TOKEN.findall(plain(text)):
        if token.isdigit():
            grams = [token, *(f"{i}:{token[i : i + 2]}" for i in range(len(token) - 1)), f"{token[:3]}*", f"*{token[-3:]}"]
            out.update(half + xxhash.xxh32_intdigest(g) % half for g in grams)
        else:
            padded = f"<{token}>"
            grams = [token, *(padded[i : i + 3] for i in range(len(padded) - 2))] if len(token) > 3 else [token]
            out.update(xxhash.xxh32_intdigest(g) % half for g in grams)
    return sorted(out)


class Encoder:
    """Unit vectors of titles: the mean of learned feature vectors."""

    def __init__(self, table: np.ndarray):
        self.table = table.astype(np.float32)

    def encode(self, texts: list[str], words_only: bool = False) -> np.ndarray:
        """One row per text; words_only leaves numbers out."""
        out = np.zeros((len(texts), self.table.shape[1]), dtype=np.float32)
        for i, text in enumerate(texts):
            found = features(text or "")
            if words_only:
                found = [x for x in found if x < BUCKETS // 2]
            if found:
                out[i] = self.table[found].sum(0)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norm, 1e-9)


def train(pairs: list[tuple[str, str]], epochs: int = 6, batch: int = 256, rate: float = 0.1, temperature: float = 0.1, seed: int = 7) -> Encoder:
    """Contrastive training: of a batch, the two titles of a pair shall be nearer than any other two (both directions)."""
    rng = np.random.default_rng(seed)
    table = rng.standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32) / np.sqrt(DIMENSIONS)
    table[BUCKETS // 2 :] *= NUMBER_SCALE
    left, right = [features(a) for a, _ in pairs], [features(b) for _, b in pairs]
    for _ in range(epochs if len(pairs) > 1 else 0):
        order = rng.permutation(len(pairs))
        for start in range(0, len(order), batch):
            take = order[start : start + batch]
            if len(take) < 2:
                continue
            sides = []
            for feats in (left, right):
                raw = np.stack([table[feats[i]].sum(0) if feats[i] else np.zeros(DIMENSIONS, np.float32) for i in take])
                norm = np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-6)
                sides.append((feats, raw / norm, norm))
            (fa, a, na), (fb, b, nb) = sides
            logits = a @ b.T / temperature
            rows = np.exp(logits - logits.max(1, keepdims=True))
            rows /= rows.sum(1, keepdims=True)
            columns = np.exp(logits - logits.max(0, keepdims=True))
            columns /= columns.sum(0, keepdims=True)
            grad = ((rows + columns) / 2 - np.eye(len(take))) / temperature
            for feats, own, norm, toward in ((fa, a, na, grad @ b), (fb, b, nb, grad.T @ a)):
                step = (toward - (toward * own).sum(1, keepdims=True) * own) / norm
                for k, i in enumerate(take):
                    if feats[i]:
                        table[feats[i]] -= rate * step[k] / np.sqrt(len(feats[i]))
    return Encoder(table)


def centroids(sample: np.ndarray, lists: int, rounds: int = 5, seed: int = 7) -> np.ndarray:
    """Spherical k-means over a sample of vectors."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample)))
    if not len(sample):
        return np.zeros((1, DIMENSIONS), np.float32)
    centre = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(part @ centre.T).argmax(1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        order = np.argsort(nearest, kind="stable")
        starts = np.searchsorted(nearest[order], np.arange(lists))
        filled = np.r_[starts[1:], len(order)] > starts
        sums = np.add.reduceat(sample[order], starts[filled], axis=0)
        centre[filled] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        centre[~filled] = sample[rng.integers(len(sample), size=int((~filled).sum()))]
    return centre.astype(np.float32)
