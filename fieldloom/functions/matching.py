"""Name similarity and assignment of the columns of two schema versions."""

from __future__ import annotations

from difflib import SequenceMatcher


def name_similarity(a: str, b: str) -> float:
    """0 to 1, blind to case and separators."""
    a, b = (x.lower().replace("_", "").replace("-", "") for x in (a, b))
    return SequenceMatcher(None, a, b).ratio()


def assign(weights: list[list[float]]) -> list[int]:
    """Maximum-weight bipartite matching: for each row its column, or -1 (weights of 0 or less don't match).

    The Hungarian algorithm with potentials on the square of the larger side.
    """
    rows, columns = len(weights), len(weights[0]) if weights else 0
    n = max(rows, columns)
    if not n:
        return []
    top = max([0.0, *(w for row in weights for w in row)])
    cost = [[top - max(0.0, weights[i][j]) if i < rows and j < columns else top for j in range(n)] for i in range(n)]
    u, v, match, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * rows
    for j in range(1, n + 1):
        i = match[j] - 1
        if i < rows and j - 1 < columns and weights[i][j - 1] > 0:
            out[i] = j - 1
    return out
