"""Pixel helpers of the image jobs: numpy functions of one image, RGB (height, width, 3) or gray (height, width) uint8."""

from __future__ import annotations

import numpy as np


def gray(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def weights(source: int, target: int, kind: str = "area") -> np.ndarray:
    """Row-normalised weights (target, source) of a one-dimensional resize: area overlap, linear between the two nearest, or Lanczos of three lobes."""
    scale = source / target
    if kind == "linear":
        x = np.clip((np.arange(target) + 0.5) * scale - 0.5, 0, source - 1)
        return np.clip(1 - np.abs(x[:, None] - np.arange(source)), 0, None)
    if kind == "area":
        edges = np.arange(target + 1) * scale
        at = np.arange(source)
        w = np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None)
    else:
        reach = max(scale, 1.0)
        x = ((np.arange(source) + 0.5) - (np.arange(target)[:, None] + 0.5) * scale) / reach
        w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
    return w / w.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, width: int, height: int, kind: str = "area") -> np.ndarray:
    if image.shape[:2] == (height, width):
        return image
    out = np.tensordot(weights(image.shape[0], height, kind), image.astype(np.float64), axes=(1, 0))
    out = np.moveaxis(np.tensordot(weights(image.shape[1], width, kind), out, axes=(1, 1)), 0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def preview(rgb: np.ndarray, most: int) -> np.ndarray:
    long = max(rgb.shape[:2])
    return rgb if long <= most else resized(rgb, max(1, round(rgb.shape[1] * most / long)), max(1, round(rgb.shape[0] * most / long)))


def _reflected(a: np.ndarray, by: int) -> np.ndarray:
    return np.pad(a, by, mode="reflect")


def laplacian(g: np.ndarray) -> np.ndarray:
    p = _reflected(g.astype(np.float64), 1)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def statistics(rgb: np.ndarray) -> dict[str, float]:
    g = gray(rgb).astype(np.float64)
    top, low = rgb.max(axis=2).astype(np.float64), rgb.min(axis=2).astype(np.float64)
    saturation = np.rint(np.divide((top - low) * 255, top, out=np.zeros_like(top), where=top > 0))
    return {k: round(float(v), 3) for k, v in (("brightness", g.mean()), ("contrast", g.std()), ("saturation", saturation.mean()), ("sharpness", laplacian(g).var()))}


def dhash_hex(g: np.ndarray, kind: str, size: int = 12) -> str:
    small = resized(g, size + 1, size, kind).astype(int)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):0{size * size // 4}x}"


def noref(rgb: np.ndarray) -> dict[str, float]:
    g = gray(rgb).astype(np.float64)
    std = g.std()
    return {"sharpness": float(laplacian(g).var()), "contrast": float(std), "color": float(lab8(rgb).reshape(-1, 3).std(axis=0).sum()), "snr": 40.0 if std == 0 else float(20 * np.log10(max(g.mean(), 1e-12) / std)), "proxy": float(max(0.0, 20 - 0.5 * std))}


def lab8(rgb: np.ndarray) -> np.ndarray:
    """CIE Lab under D65 in the 8-bit scale: L * 255 / 100, a + 128, b + 128."""
    c = rgb / 255.0
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    xyz = c @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([(116 * f[..., 1] - 16) * 2.55, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)


def psnr(a: np.ndarray, b: np.ndarray) -> float:
    mse = ((a.astype(np.float64) - b) ** 2).mean()
    return float("inf") if mse == 0 else float(20 * np.log10(255 / np.sqrt(mse)))


def pair_difference(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    d = a.astype(np.float64) - b
    mse = (d * d).mean()
    shift = np.abs(a.reshape(-1, a.shape[2]).mean(axis=0) - b.reshape(-1, b.shape[2]).mean(axis=0)).mean()
    return {"mae": float(np.abs(d).mean()), "psnr": 99.0 if mse == 0 else float(20 * np.log10(255 / np.sqrt(mse))), "shift": float(shift)}


def box(x: np.ndarray, k: int) -> np.ndarray:
    """Sums over all k x k windows that lie inside, by cumulative sums."""
    s = np.pad(x.astype(np.float64), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]


def ssim(a: np.ndarray, b: np.ndarray, k: int = 7) -> float:
    """Mean structural similarity over channels: uniform windows, sample covariance, K1 0.01, K2 0.03."""
    n, c1, c2 = k * k, (0.01 * 255) ** 2, (0.03 * 255) ** 2
    out = []
    for c in range(a.shape[2]):
        x, y = a[..., c].astype(np.float64), b[..., c].astype(np.float64)
        mx, my = box(x, k) / n, box(y, k) / n
        vx, vy, vxy = ((box(p, k) / n - q) * n / (n - 1) for p, q in ((x * x, mx * mx), (y * y, my * my), (x * y, mx * my)))
        out.append((((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean())
    return float(np.mean(out))


def ssim_loss(a: np.ndarray, b: np.ndarray, k: int = 7) -> float:
    """1 - SSIM of images scaled to [-1, 1]: zero padding, population moments, C1 0.02², C2 0.06²."""
    c1, c2 = 0.02**2, 0.06**2
    mean = lambda v: box(np.pad(v, k // 2), k) / (k * k)
    out = []
    for c in range(a.shape[2]):
        x, y = a[..., c] / 127.5 - 1, b[..., c] / 127.5 - 1
        mx, my = mean(x), mean(y)
        vx, vy, vxy = mean(x * x) - mx * mx, mean(y * y) - my * my, mean(x * y) - mx * my
        out.append((((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean())
    return 1 - float(np.mean(out))


def upright(rgb: np.ndarray, orientation: int) -> np.ndarray:
    """An image turned and flipped as its EXIF orientation (1 to 8) asks."""
    out = rgb[:, ::-1] if orientation in (2, 4, 5, 7) else rgb
    turns = {3: 2, 4: 2, 5: 1, 6: 3, 7: 3, 8: 1}.get(orientation, 0)
    return np.ascontiguousarray(np.rot90(out, turns))


def line_boxes(g: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(y, x, height, width) of the parts, 5x5 at least, whose black-hat along one of two lengths of rows and columns is above its 90th percentile."""
    out = []
    for n in (15, 21):
        for dy, dx in ((0, 1), (1, 0)):
            found = black_hat(g, _line(n, dy, dx))
            label = components(found > np.percentile(found, 90))
            ys, xs = np.nonzero(label)
            names, of = np.unique(label[ys, xs], return_inverse=True)
            low, high = np.full((2, len(names)), max(g.shape)), np.full((2, len(names)), -1)
            for k, at in enumerate((ys, xs)):
                np.minimum.at(low[k], of, at)
                np.maximum.at(high[k], of, at)
            sizes = high - low + 1
            out += [(int(low[0, i]), int(low[1, i]), int(sizes[0, i]), int(sizes[1, i])) for i in np.flatnonzero((sizes >= 5).all(axis=0))]
    return out


def _slid(a: np.ndarray, offsets: list[tuple[int, int]], pick) -> np.ndarray:
    """Minimum or maximum over shifted copies; what lies outside doesn't count."""
    by = max(max(abs(y), abs(x)) for y, x in offsets)
    p = np.pad(a, by, constant_values=a.min() if pick is np.maximum else a.max())
    out = None
    for y, x in offsets:
        part = p[by + y : by + y + a.shape[0], by + x : by + x + a.shape[1]]
        out = part if out is None else pick(out, part)
    return out


def _line(n: int, dy: int, dx: int) -> list[tuple[int, int]]:
    return [(i * dy, i * dx) for i in range(-(n // 2), n // 2 + 1)]


def black_hat(g: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    """How much darker a pixel is than the closing along a line."""
    return _slid(_slid(g, offsets, np.maximum), offsets, np.minimum).astype(int) - g


def _ellipse(k: int) -> list[tuple[int, int]]:
    """Offsets of a filled ellipse of k rows and columns about the place k // 2."""
    r = k // 2
    reach = [round(np.sqrt(r * r - y * y)) for y in range(-r, k - r)]
    return [(y, x) for y, n in zip(range(-r, k - r), reach, strict=True) for x in range(max(-n, -r), min(n, k - 1 - r) + 1)]


def dilate(m: np.ndarray, k: int = 3) -> np.ndarray:
    return _slid(m, _ellipse(k), np.maximum)


def erode(m: np.ndarray, k: int = 3) -> np.ndarray:
    return _slid(m, _ellipse(k), np.minimum)


def opened(m: np.ndarray, k: int = 3) -> np.ndarray:
    return dilate(erode(m, k), k)


def closed(m: np.ndarray, k: int = 3) -> np.ndarray:
    return erode(dilate(m, k), k)


def gaussian(m: np.ndarray, k: int) -> np.ndarray:
    """An 8-bit image blurred by k x k Gaussian weights; binomial ones up to 5, else of deviation 0.15 k + 0.35."""
    if k <= 5:
        w = np.array({3: [1, 2, 1], 5: [1, 4, 6, 4, 1]}[k], dtype=np.float64)
    else:
        w = np.exp(-((np.arange(k) - k // 2) ** 2) / (2 * (0.15 * k + 0.35) ** 2))
    p, h = _reflected(m.astype(np.float64), k // 2), m.shape
    rows = sum(v * p[i : i + h[0]] for i, v in enumerate(w / w.sum()))
    return np.floor(sum(v * rows[:, i : i + h[1]] for i, v in enumerate(w / w.sum())) + 0.5).astype(np.uint8)


def blurred(x: np.ndarray, k: int) -> np.ndarray:
    return box(_reflected(x.astype(np.float64), k // 2), k) / (k * k)


_AROUND = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)]


def components(m: np.ndarray, around: list[tuple[int, int]] = _AROUND) -> np.ndarray:
    """Labels of the connected parts (by all eight neighbours, or those given) of a boolean mask, 0 outside, by passing on the largest label until nothing changes."""
    label = np.where(m, np.arange(1, m.size + 1).reshape(m.shape), 0)
    while True:
        new = np.where(m, _slid(label, around, np.maximum), 0)
        flat = np.r_[0, new.ravel()]
        new = np.where(m, flat[new], 0)  # jump to the label of the label
        if (new == label).all():
            return label
        label = new


def filled(m: np.ndarray) -> np.ndarray:
    """A mask with its holes: what its outside, reached from the border over four neighbours, leaves."""
    outside = components(np.pad(~m, 1, constant_values=True), _ellipse(3))
    return (outside != outside[0, 0])[1:-1, 1:-1]


def by_area(m: np.ndarray, least: int, most: float = np.inf) -> np.ndarray:
    """The parts of a mask whose pixel count lies in a range."""
    label = components(m)
    sizes = np.bincount(label.ravel(), minlength=label.size + 1)
    fit = (sizes >= least) & (sizes <= most)
    fit[0] = False
    return fit[label]


def _gray_of(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else gray(image)


def _local_spread(x: np.ndarray, k: int) -> np.ndarray:
    """Mean squared distance of the pixels around each from their own local means."""
    return np.clip(blurred((x - blurred(x, k)) ** 2, k), 0, None)


def _thin(g: np.ndarray, lengths: tuple[int, ...], slanted: tuple[int, ...], limit: int) -> np.ndarray:
    """Dark lines along rows, columns and both diagonals."""
    lines = [_line(n, dy, dx) for n in lengths for dy, dx in ((0, 1), (1, 0))] + [_line(n, 1, s) for n in slanted for s in (1, -1)]
    return np.max([black_hat(g, o) for o in lines], axis=0) > limit


def _spots(m: np.ndarray, k: int) -> np.ndarray:
    return opened(m.astype(np.uint8), k) > 0


def morph_mask(image: np.ndarray, sensitivity: float) -> np.ndarray:
    """Thin dark lines, local defects, bright spots of fitting area and dark spots; specks of up to five pixels go."""
    g = _gray_of(image)
    x = g.astype(np.float64)
    thin = _thin(gaussian(g, 3), (15, 21, 31), (11,), 8 + int(15 * sensitivity))
    local = (np.abs(x - blurred(x, 31)) > 30) & (np.sqrt(_local_spread(x, 31)) < 20)
    bright = by_area(filled(_spots(g > 250, 3)), 11, 499)
    found = opened((thin | local | bright | _spots(g < 5, 3)).astype(np.uint8), 2) > 0
    return gaussian(dilate(by_area(filled(found), 6).astype(np.uint8) * 255), 3)


def texture_mask(image: np.ndarray, sensitivity: float) -> np.ndarray:
    """Scratches, dust of fitting area, and white and dark areas."""
    g = _gray_of(image)
    thin = _thin(g, (9, 15, 21), (7, 11), 10 + int(20 * sensitivity))
    dust = closed((np.abs(g.astype(int) - gaussian(g, 5)) > 15).astype(np.uint8)) > 0
    found = thin | by_area(filled(dust), 6, 1999) | _spots(g > 245, 2) | _spots(g < 10, 2)
    return gaussian(dilate(closed(found.astype(np.uint8) * 255, 2)), 5)


def otsu(values: np.ndarray) -> int:
    """The threshold of 8-bit values with the largest variance between the classes."""
    h = np.bincount(values.ravel(), minlength=256).astype(np.float64)
    w, s = h.cumsum(), (h * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (s[-1] * w - s * w[-1]) ** 2 / (w * (w[-1] - w))
    return int(np.nan_to_num(between, nan=0.0, posinf=0.0).argmax())


def adaptive_mask(image: np.ndarray, sensitivity: float) -> np.ndarray:
    """Local variance at three sizes and the Laplacian, fused and cut at Otsu's threshold, with white and dark areas; a flat gray if they cover less than 1 %."""
    g = _gray_of(image)
    fused = 0.7 * np.mean([_local_spread(g.astype(np.float64), k) for k in (3, 7, 15)], axis=0) + 0.3 * np.abs(laplacian(gaussian(g, 5)))
    scaled = (fused / (fused.max() + 1e-6) * 255).astype(np.uint8)
    rough = gaussian(dilate(dilate((scaled > otsu(scaled)).astype(np.uint8) * 255, 5), 5), 11)
    top, low = (g, g) if image.ndim == 2 else (image.max(axis=2), image.min(axis=2))
    out = np.where((low > 240) | (top < 15), 255, rough).astype(np.uint8)
    return out if out.sum() / 255 >= 0.01 * out.size else np.full(g.shape, int(128 * sensitivity), np.uint8)


#: Detectors of damage: functions of an image (RGB or gray) and a sensitivity from 0 to 1. Areas, lengths and limits in them are fixed values.
DETECTORS = {"morph": morph_mask, "texture": texture_mask, "adaptive": adaptive_mask, "full": lambda image, s: np.full(image.shape[:2], 255, np.uint8)}


def texture_cover(texture: np.ndarray, height: int, width: int, floor: int, rng: np.random.Generator) -> np.ndarray:
    """A texture over a whole image, cropped at a random place or tiled, as weights from 0 (``floor`` or darker) to 1."""
    h, w = texture.shape
    if h < height or w < width:
        part = np.tile(texture, (-(-height // h), -(-width // w)))[:height, :width]
    else:
        y, x = int(rng.integers(0, h - height + 1)), int(rng.integers(0, w - width + 1))
        part = texture[y : y + height, x : x + width]
    return np.clip(part.astype(np.float64) - floor, 0, None) / (255 - floor)


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 255).astype(np.uint8)


def worn(rgb: np.ndarray, covers: list[np.ndarray]) -> np.ndarray:
    """Scratches and stains by the first cover; scuffs, dust and darker corners by the second."""
    out = rgb.astype(np.float64)
    if covers:
        c = covers[0][..., None]
        out = (out + 120 * c) * (1 - 0.2 * c) + np.array([60, 50, 40]) * 0.2 * c
    if len(covers) > 1:
        c = covers[1]
        out = out + 60 * c[..., None]
        out = np.where((c > 0.5)[..., None], np.minimum(out + 80, 255), out)
        h, w = c.shape
        third = min(h, w) // 3
        edge = lambda n: np.minimum(np.arange(n), np.arange(n)[::-1]) < third
        out = out * (1 - 0.5 * c * np.outer(edge(h), edge(w)))[..., None]
    return _bytes(out)


def age(rgb: np.ndarray, seed: int, textures: list[np.ndarray] = ()) -> np.ndarray:
    """Wear, sepia, fading, vignette and grain, in that order, cut to 8 bits after each."""
    rng = np.random.default_rng(seed)
    h, w = rgb.shape[:2]
    chosen = [textures[i] for i in rng.permutation(len(textures))[:2]]
    out = worn(rgb, [texture_cover(t, h, w, floor, rng) for t, floor in zip(chosen, (30, 35), strict=False)])
    sepia = np.clip(out @ np.array([[0.393, 0.769, 0.189], [0.349, 0.686, 0.168], [0.272, 0.534, 0.131]]).T, 0, 255)
    out = _bytes(0.75 * out + 0.25 * sepia)
    out = _bytes(0.9 * out + 0.1 * 255)
    away = ((np.arange(h) - h / 2) ** 2)[:, None] + ((np.arange(w) - w / 2) ** 2)[None]
    out = _bytes(out * np.clip(1 - 0.4 * away / ((h * h + w * w) / 4), 0.2, 1)[..., None])
    return _bytes(out + rng.normal(0, 20, out.shape))


def degraded(rgb: np.ndarray, params: dict, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """An image worn as ``params`` says, and the opacity (8 bits) of its scratches and stains; global steps leave no mask."""
    rng = np.random.default_rng(seed)
    h, w = rgb.shape[:2]
    ys, xs = np.mgrid[:h, :w].astype(np.float64)
    opacity, out = np.zeros((h, w)), rgb.astype(np.float64)
    for _ in range(params["scratches"]):
        y, x, turn = rng.uniform(0, h), rng.uniform(0, w), rng.uniform(0, np.pi)
        along, across = (xs - x) * np.cos(turn) + (ys - y) * np.sin(turn), (ys - y) * np.cos(turn) - (xs - x) * np.sin(turn)
        layer = np.clip(1.2 - np.abs(across), 0, 1) * (np.abs(along) < rng.uniform(0.1, 0.5) * max(h, w))
        out = out * (1 - layer[..., None]) + rng.uniform(180, 255) * layer[..., None]
        opacity = np.maximum(opacity, layer)
    for _ in range(params["stains"]):
        y, x, r = rng.uniform(0, h), rng.uniform(0, w), rng.uniform(0.03, 0.12) * max(h, w)
        layer = 0.8 * np.clip(1.5 - np.hypot(ys - y, xs - x) / r, 0, 1)
        out = out * (1 - layer[..., None]) + np.array([90.0, 70.0, 45.0]) * layer[..., None]
        opacity = np.maximum(opacity, layer)
    brown = np.clip(out @ np.array([[0.393, 0.769, 0.189], [0.349, 0.686, 0.168], [0.272, 0.534, 0.131]]).T, 0, 255)
    out = (1 - params["sepia"]) * out + params["sepia"] * brown
    out = (1 - params["fade"]) * out + params["fade"] * 255
    away = ((ys - h / 2) ** 2 + (xs - w / 2) ** 2) / ((h * h + w * w) / 4)
    out = out * np.clip(1 - params["vignette"] * away, 0.2, 1)[..., None] + rng.normal(0, params["grain"], out.shape)
    return _bytes(out), np.ceil(opacity * 255).astype(np.uint8)


def colour_correct(rgb: np.ndarray) -> np.ndarray:
    """Gray-world gains, then more saturation and brightness."""
    means = rgb.reshape(-1, 3).mean(axis=0)
    out = np.clip(rgb * (means.mean() / np.maximum(means, 1e-6)), 0, 255)
    mid = out.mean(axis=2, keepdims=True)
    return np.clip((mid + (out - mid) * 1.1) * 1.05, 0, 255).astype(np.uint8)


def paired_crop(a: np.ndarray, b: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The same crop, flip and quarter turns of two images, which are padded by reflection if too small."""
    rng = np.random.default_rng(seed)
    grown = [np.pad(x, [(0, max(0, size - x.shape[0])), (0, max(0, size - x.shape[1])), (0, 0)], mode="reflect" if min(x.shape[:2]) > 1 else "edge") for x in (a, b)]
    y, x = (int(rng.integers(0, n - size + 1)) for n in grown[0].shape[:2])
    flip, turns = bool(rng.integers(2)), int(rng.integers(4))
    out = [g[y : y + size, x : x + size] for g in grown]
    return tuple(np.ascontiguousarray(np.rot90(o[:, ::-1] if flip else o, turns)) for o in out)
