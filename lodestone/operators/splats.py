"""Simplification of Gaussian splats: cheapest neighbours merge, and a merged splat keeps their moments.

Works on the splats of one tile, as numpy arrays with a row a splat.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# fixed values
NEIGHBOURS = 8
COLOUR_WEIGHT = 0.45
CELL_FACTOR, EXTENT_FACTOR = 1.5, 0.04
LEAST_CELL = 1e-6
LEAST_WEIGHT = 1e-12
LEAST_SCALE, LEAST_SCALE_RATIO = 1e-12, 1e-4
LEAST_DETERMINANT = 1e-300
THIN, SURFACE_SHARE, SURFACE_COHERENCE, THICKER, LEAST_THICKNESS = 0.35, 0.65, 0.85, 4.0, 1e-10
SH_C0 = 0.28209479177387814


@dataclass
class Splats:
    index: np.ndarray
    centre: np.ndarray
    quaternion: np.ndarray  # w, x, y, z
    scale: np.ndarray
    opacity: np.ndarray
    sh0: np.ndarray
    sh: np.ndarray  # (n, coefficients, 3)

    def __len__(self) -> int:
        return len(self.index)

    def take(self, rows) -> Splats:
        return Splats(*(getattr(self, f)[rows] for f in self.__dataclass_fields__))

    @staticmethod
    def joined(parts: list[Splats]) -> Splats:
        return Splats(*(np.concatenate([getattr(p, f) for p in parts]) for f in Splats.__dataclass_fields__))


def matrices(q: np.ndarray) -> np.ndarray:
    w, x, y, z = q.T
    rows = [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]
    return np.stack(rows, axis=1).reshape(-1, 3, 3)


def quaternions(m: np.ndarray) -> np.ndarray:
    """Of rotation matrices, by the largest of the four components."""
    trace = np.trace(m, axis1=1, axis2=2)
    d = np.stack([trace, m[:, 0, 0], m[:, 1, 1], m[:, 2, 2]], axis=1)
    out = np.empty((len(m), 4))
    for k in range(4):
        i = d.argmax(axis=1) == k
        s = m[i]
        if k == 0:
            out[i] = np.stack([1 + trace[i], s[:, 2, 1] - s[:, 1, 2], s[:, 0, 2] - s[:, 2, 0], s[:, 1, 0] - s[:, 0, 1]], axis=1)
        elif k == 1:
            out[i] = np.stack([s[:, 2, 1] - s[:, 1, 2], 1 + 2 * s[:, 0, 0] - trace[i], s[:, 0, 1] + s[:, 1, 0], s[:, 0, 2] + s[:, 2, 0]], axis=1)
        elif k == 2:
            out[i] = np.stack([s[:, 0, 2] - s[:, 2, 0], s[:, 0, 1] + s[:, 1, 0], 1 + 2 * s[:, 1, 1] - trace[i], s[:, 1, 2] + s[:, 2, 1]], axis=1)
        else:
            out[i] = np.stack([s[:, 1, 0] - s[:, 0, 1], s[:, 0, 2] + s[:, 2, 0], s[:, 1, 2] + s[:, 2, 1], 1 + 2 * s[:, 2, 2] - trace[i]], axis=1)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def covariances(q: np.ndarray, scale: np.ndarray) -> np.ndarray:
    r = matrices(q) * scale[:, None, :]
    return r @ r.transpose(0, 2, 1)


def weights(s: Splats) -> np.ndarray:
    """Opacity times mean projected area."""
    x, y, z = s.scale.T
    return np.maximum(LEAST_WEIGHT, s.opacity * np.maximum((x * y + x * z + y * z) / 3, LEAST_WEIGHT))


def cell_size(size: np.ndarray, count: int) -> float:
    """Spacing of evenly spread splats; sides of at most a twentieth of the longest don't count."""
    if not size.max() > 0:
        return LEAST_CELL
    sides = size[size > size.max() * 0.05]
    return max(LEAST_CELL, float(np.prod(sides) / count) ** (1 / len(sides)))


def merge_distance(centre: np.ndarray, target: int) -> float:
    size = centre.max(axis=0) - centre.min(axis=0)
    limit = CELL_FACTOR * cell_size(size, target)
    return min(limit, EXTENT_FACTOR * float(size.max())) if size.max() > 0 else limit


PAIRS = 4_000_000  # that are measured at once


def neighbour_edges(centre: np.ndarray, radius: float, k: int = NEIGHBOURS) -> np.ndarray:
    """Pairs (a < b) of which one is among the k nearest of the other, within the radius.

    Ties go to the index that follows the point's own first, counted around.
    Splats are binned in cells of the radius, and each bin meets the 27 around it.
    """
    n = len(centre)
    cells = np.floor((centre - centre.min(axis=0)) / radius).astype(np.int64)
    span = cells.max(axis=0) + 3
    key = ((cells[:, 0] + 1) * span[1] + cells[:, 1] + 1) * span[2] + cells[:, 2] + 1
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    shifts = [(i * span[1] + j) * span[2] for i in (-1, 0, 1) for j in (-1, 0, 1)]
    # three cells in a row along z are one run of keys
    low = np.stack([np.searchsorted(sorted_key, key + s - 1, "left") for s in shifts])
    many = np.stack([np.searchsorted(sorted_key, key + s + 1, "right") for s in shifts]) - low
    upto, out, a = np.cumsum(many.sum(axis=0)), [], 0
    while a < n:  # so many splats at once that they meet at most PAIRS others
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
        rows = np.arange(a, b)
        owner, other = [], []
        for first, m in zip(low[:, a:b], many[:, a:b], strict=True):
            owner.append(np.repeat(rows, m))
            other.append(order[np.repeat(first - np.cumsum(m) + m, m) + np.arange(m.sum())])
        a = b
        owner, other = np.concatenate(owner), np.concatenate(other)
        keep = owner != other
        owner, other = owner[keep], other[keep]
        d2 = ((centre[owner] - centre[other]) ** 2).sum(axis=1)
        keep = d2 <= radius * radius
        owner, other, d2 = owner[keep], other[keep], d2[keep]
        rank = np.lexsort(((other - owner) % n, d2, owner))
        owner, other = owner[rank], other[rank]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
        out.append(np.stack([owner[place < k], other[place < k]], axis=1))
    pairs = np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)
    return np.unique(np.sort(pairs, axis=1), axis=0)


def merge_costs(s: Splats, pairs: np.ndarray) -> np.ndarray:
    """Bound on the divergence between two splats and their merger, and the weighted distance of their colours."""
    a, b = pairs.T
    w = weights(s)
    floor = np.maximum(s.scale.max(axis=1) * LEAST_SCALE_RATIO, LEAST_SCALE)[:, None]
    cov = covariances(s.quaternion, np.maximum(s.scale, floor))
    log = lambda c: np.log(np.maximum(np.nan_to_num(np.linalg.det(c)), LEAST_DETERMINANT))
    total, d = w[a] + w[b], s.centre[a] - s.centre[b]
    u, v = (w[a] / total)[:, None, None], (w[b] / total)[:, None, None]
    both = u * cov[a] + v * cov[b] + u * v * d[:, :, None] * d[:, None, :]
    own = log(cov)
    shape = np.maximum(0, (total * log(both) - w[a] * own[a] - w[b] * own[b]) / 2)
    colour = 0.5 + SH_C0 * s.sh0
    return shape + COLOUR_WEIGHT * total * ((colour[a] - colour[b]) ** 2).sum(axis=1)


def merged(s: Splats, groups: np.ndarray) -> Splats:
    """One splat for each row of indices, with their weighted mean and covariance.

    Opacities add like layers; higher harmonics are the heaviest splat's.  Where thin splats
    that agree on a normal hold most of the weight, the thickness along it is capped.
    """
    w = weights(s)[groups]
    total = w.sum(axis=1)
    p = w / total[:, None]
    centre = (p[..., None] * s.centre[groups]).sum(axis=1)
    d = s.centre[groups] - centre[:, None]
    rotation = matrices(s.quaternion)[groups]
    spread = covariances(s.quaternion, s.scale)[groups] + d[..., :, None] * d[..., None, :]
    cov = (p[..., None, None] * spread).sum(axis=1)
    scale = s.scale[groups]
    short = scale.argmin(axis=2)
    least, most = scale.min(axis=2), scale.max(axis=2)
    thin = (least > 0) & (least <= THIN * most)
    normal = np.take_along_axis(rotation, short[..., None, None], axis=3)[..., 0]
    first = thin.argmax(axis=1)
    reference = normal[np.arange(len(groups)), first]
    normal = np.where(((normal * reference[:, None]).sum(axis=2) < 0)[..., None], -normal, normal)
    tw = np.where(thin, w, 0.0)
    surface = tw.sum(axis=1)
    summed = (tw[..., None] * normal).sum(axis=1)
    length = np.linalg.norm(summed, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        limit = np.maximum(THICKER * (tw * least**2).sum(axis=1) / surface, LEAST_THICKNESS)
        n = summed / length[:, None]
    across = np.einsum("ni,nij,nj->n", np.nan_to_num(n), cov, np.nan_to_num(n))
    cap = (surface > 0) & (surface >= SURFACE_SHARE * total) & (length >= SURFACE_COHERENCE * surface) & (across > np.nan_to_num(limit, nan=np.inf))
    if cap.any():
        m, c = n[cap], cov[cap]
        flat = np.eye(3) - m[:, :, None] * m[:, None, :]
        cov[cap] = flat @ c @ flat + limit[cap, None, None] * m[:, :, None] * m[:, None, :]
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[:, ::-1], vectors[:, :, ::-1].copy()
    vectors[np.linalg.det(vectors) < 0, :, 2] *= -1
    heavy = groups[np.arange(len(groups)), w.argmax(axis=1)]
    return Splats(
        s.index[groups].min(axis=1),
        centre,
        quaternions(vectors),
        np.sqrt(np.maximum(values, 0)),
        1 - np.prod(1 - np.clip(s.opacity[groups], 0, 1), axis=1),
        (p[..., None] * s.sh0[groups]).sum(axis=1),
        s.sh[heavy],
    )


def simplify(s: Splats, target: int) -> Splats:
    """About ``target`` splats, by their index; more where nothing is near enough to merge."""
    if target < 1 and len(s):
        raise ValueError("the target must be positive")
    while len(s) > target:
        pairs = neighbour_edges(s.centre, merge_distance(s.centre, target))
        if not len(pairs):
            break
        cost = merge_costs(s, pairs)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0], cost))]
        most, used, chosen = min(len(s) - target, len(s) // 2), np.zeros(len(s), dtype=bool), []
        for a, b in pairs.tolist():
            if len(chosen) == most:
                break
            if not used[a] and not used[b]:
                used[a] = used[b] = True
                chosen.append((a, b))
        s = Splats.joined([merged(s, np.array(chosen)), s.take(~used)])
    return s.take(np.argsort(s.index, kind="stable"))


# ---------------------------------------------------------------- spherical harmonics


def sh_basis(d: np.ndarray) -> np.ndarray:
    """Real basis of degrees 1 to 3 at unit directions, in the order of splat files."""
    x, y, z = d.T
    xx, yy, zz, xy, yz, xz = x * x, y * y, z * z, x * y, y * z, x * z
    c1 = 0.4886025119029199
    rows = [-c1 * y, c1 * z, -c1 * x]
    rows += [1.0925484305920792 * xy, -1.0925484305920792 * yz, 0.31539156525252005 * (2 * zz - xx - yy), -1.0925484305920792 * xz, 0.5462742152960396 * (xx - yy)]
    rows += [
        -0.5900435899266435 * y * (3 * xx - yy),
        2.890611442640554 * xy * z,
        -0.4570457994644658 * y * (4 * zz - xx - yy),
        0.3731763325901154 * z * (2 * zz - 3 * xx - 3 * yy),
        -0.4570457994644658 * x * (4 * zz - xx - yy),
        1.445305721320277 * z * (xx - yy),
        -0.5900435899266435 * x * (xx - 3 * yy),
    ]
    return np.stack(rows, axis=1)


def sh_rotation(turn: np.ndarray, degree: int) -> list[np.ndarray]:
    """A matrix for each band: coefficients seen from directions turned by ``turn``."""
    rng = np.random.default_rng(0)
    d = rng.normal(size=(64, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    before, after, out, at = sh_basis(d), sh_basis(d @ turn), [], 0
    for band in range(1, degree + 1):
        n = 2 * band + 1
        # f(turned d) = sum after c, and must be sum before c'
        out.append(np.linalg.lstsq(before[:, at : at + n], after[:, at : at + n], rcond=None)[0])
        at += n
    return out


def rotated(s: Splats, turn: np.ndarray) -> Splats:
    """All splats turned about the origin, with their harmonics."""
    sh, at = s.sh.copy(), 0
    for m in sh_rotation(turn, {0: 0, 3: 1, 8: 2, 15: 3}[s.sh.shape[1]]):
        n = len(m)
        sh[:, at : at + n] = np.einsum("ij,njc->nic", m, s.sh[:, at : at + n])
        at += n
    return Splats(s.index, s.centre @ turn.T, quaternions(turn @ matrices(s.quaternion)), s.scale, s.opacity, s.sh0, sh)
