"""Image functions in numpy on single images (2-D uint8 gray, or 3-D uint8 RGB), and their Arrow form.

Pixels stay in their row: `per_image` runs a function over a binary column in batches and nothing is shuffled.
Rounding is half away from zero; divisions of whole numbers truncate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Face size of recognition, grid of the texture histogram, side and cell of the gradient descriptor.
FACE_W, FACE_H, GRID, HOG_SIDE, HOG_CELL, HOG_BINS = 92, 112, 8, 64, 8, 9
#: Neighbours of a texture code, by bit: offsets in x and y.
LBP_RING = ((-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1))


def half_up(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def gray(image: np.ndarray) -> np.ndarray:
    """RGB to gray by (77 R + 150 G + 29 B) / 256; gray stays."""
    if image.ndim == 2:
        return image
    c = image.astype(np.uint32)
    return ((77 * c[..., 0] + 150 * c[..., 1] + 29 * c[..., 2]) >> 8).astype(np.uint8)


def crop(image: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """The part inside the image; a negative origin becomes zero."""
    x, y = max(x, 0), max(y, 0)
    return image[y : y + max(h, 0), x : x + max(w, 0)]


def flip(image: np.ndarray) -> np.ndarray:
    return image[:, ::-1]


def resize_bilinear(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """Sources lie at place * old / new, without a half-pixel offset, inside the image."""
    old_h, old_w = image.shape[:2]
    if (old_w, old_h) == (w, h):
        return image.copy()

    def axis(new: int, old: int):
        at = np.minimum(np.arange(new) * (old / new), old - 1.0)
        low = np.floor(at).astype(np.int64)
        return low, np.minimum(low + 1, old - 1), at - low

    y0, y1, dy = axis(h, old_h)
    x0, x1, dx = axis(w, old_w)
    p = image.astype(np.float64)
    if image.ndim == 3:
        dx, dy = dx[:, None], dy[:, None]
        dy = dy[:, None]
    else:
        dy = dy[:, None]
    top = p[y0][:, x0] * (1 - dx) + p[y0][:, x1] * dx
    low = p[y1][:, x0] * (1 - dx) + p[y1][:, x1] * dx
    return np.clip(half_up(top * (1 - dy) + low * dy), 0, 255).astype(np.uint8)


def resize_nearest(image: np.ndarray, w: int, h: int) -> np.ndarray:
    """Source place = place * old // new."""
    old_h, old_w = image.shape[:2]
    return image[np.arange(h) * old_h // h][:, np.arange(w) * old_w // w]


def centre_square(image: np.ndarray) -> np.ndarray:
    h, w = image.shape[:2]
    side = min(w, h)
    return image[(h - side) // 2 : (h - side) // 2 + side, (w - side) // 2 : (w - side) // 2 + side]


def equalise(image: np.ndarray) -> np.ndarray:
    """Each level becomes round(255 * share of pixels at or under it)."""
    cdf = np.cumsum(np.bincount(image.ravel(), minlength=256))
    return half_up(cdf / max(int(cdf[-1]), 1) * 255.0).astype(np.uint8)[image]


def standardise(image: np.ndarray) -> np.ndarray:
    """Zero mean and unit population deviation; a deviation under 1 counts as 1."""
    v = image.astype(np.float64)
    return (v - v.mean()) / max(float(v.std()), 1.0)


def integral(image: np.ndarray) -> np.ndarray:
    """(h + 1) x (w + 1) sums of all pixels above and to the left."""
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    out[1:, 1:] = image.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    return out


def box_sum(table: np.ndarray, x, y, w, h):
    """Sum over boxes (arrays allowed). A negative origin moves to zero and keeps the size; far edges clamp."""
    x0, y0 = np.maximum(x, 0), np.maximum(y, 0)
    x2 = np.minimum(x0 + w, table.shape[1] - 1)
    y2 = np.minimum(y0 + h, table.shape[0] - 1)
    some = (np.asarray(w) > 0) & (np.asarray(h) > 0) & (x2 > x0) & (y2 > y0)
    x0, y0 = np.minimum(x0, table.shape[1] - 1), np.minimum(y0, table.shape[0] - 1)
    x2, y2 = np.maximum(x2, 0), np.maximum(y2, 0)
    return np.where(some, table[y0, x0] + table[y2, x2] - table[y0, x2] - table[y2, x0], 0)


def window_stats(table: np.ndarray, squares: np.ndarray, x, y, w, h):
    """Mean and deviation over the nominal area; variance is never negative, an empty window gives zeros."""
    area = np.maximum(w, 0) * np.maximum(h, 0)
    safe = np.maximum(area, 1)
    mean = np.where(area > 0, box_sum(table, x, y, w, h) / safe, 0.0)
    var = np.where(area > 0, box_sum(squares, x, y, w, h) / safe - mean * mean, 0.0)
    return mean, np.sqrt(np.maximum(var, 0.0))


def laplacian_variance(image: np.ndarray) -> float:
    """Variance of 8 times the pixel less its eight neighbours, over inner pixels."""
    h, w = image.shape
    if w < 3 or h < 3:
        return 0.0
    v = image.astype(np.float64)
    around = sum(v[1 + j : h - 1 + j, 1 + i : w - 1 + i] for j in (-1, 0, 1) for i in (-1, 0, 1))
    lap = 9.0 * v[1:-1, 1:-1] - around
    return float((lap * lap).mean() - lap.mean() ** 2)


def _padded_box(shape, box, pad: float) -> tuple[int, int, int, int]:
    """The box widened by whole pixels of pad times its size on each side, inside the image."""
    x, y, w, h = box
    px, py = int(np.float32(w) * np.float32(pad)), int(np.float32(h) * np.float32(pad))
    x0, y0 = max(x - px, 0), max(y - py, 0)
    return x0, y0, max(min(w + 2 * px, shape[1] - x0), 0), max(min(h + 2 * py, shape[0] - y0), 0)


def sharpness(image: np.ndarray, box) -> float:
    """Laplacian variance of the face widened by 15 %, first channel."""
    part = crop(image, *_padded_box(image.shape, box, 0.15))
    return laplacian_variance(part if part.ndim == 2 else part[..., 0])


def landmarks(box) -> list[tuple[int, int]]:
    """Eyes, nose and mouth corners at fixed shares of the box."""
    x, y, w, h = box
    return [(x + w // 4, y + h // 3), (x + w * 3 // 4, y + h // 3), (x + w // 2, y + h // 2), (x + w // 4, y + h * 5 // 6), (x + w * 3 // 4, y + h * 5 // 6)]


def align(image: np.ndarray, box, points, w: int, h: int) -> np.ndarray:
    """Rotated and scaled so that the eyes lie level, 0.35 w apart, around (w / 2, 0.4 h); outside is black."""
    source = gray(image)
    (lx, ly), (rx, ry) = points[0], points[1]
    dx, dy = float(rx - lx), float(ry - ly)
    angle, apart = np.arctan2(dy, dx), np.hypot(dx, dy)
    scale = w * 0.35 / apart if apart > 1 else w / box[2]
    gx, gy = np.meshgrid((np.arange(w) - w * 0.5) / scale, (np.arange(h) - h * 0.4) / scale)
    sx = half_up(np.cos(angle) * gx + np.sin(angle) * gy + (lx + rx) / 2).astype(np.int64)
    sy = half_up(-np.sin(angle) * gx + np.cos(angle) * gy + (ly + ry) / 2).astype(np.int64)
    inside = (sx >= 0) & (sx < source.shape[1]) & (sy >= 0) & (sy < source.shape[0])
    return np.where(inside, source[np.clip(sy, 0, source.shape[0] - 1), np.clip(sx, 0, source.shape[1] - 1)], 0).astype(np.uint8)


def padded_crop(image: np.ndarray, box, w: int, h: int, pad: float) -> np.ndarray:
    return resize_bilinear(crop(image, *_padded_box(image.shape, box, pad)), w, h)


def preprocess(image: np.ndarray, box=None, size: tuple[int, int] = (FACE_W, FACE_H)) -> np.ndarray:
    """What recognition models read: cropped or whole, gray, equalised, standardised, as one vector."""
    part = padded_crop(image, box, *size, 0.15) if box is not None else resize_bilinear(image, *size)
    return standardise(equalise(gray(part))).ravel()


def texture_codes(image: np.ndarray) -> np.ndarray:
    """Bit k is set where neighbour k is at least the pixel; the border is 0."""
    h, w = image.shape
    out = np.zeros((h, w), np.uint8)
    if h > 2 and w > 2:
        inner = image[1:-1, 1:-1]
        for k, (i, j) in enumerate(LBP_RING):
            out[1:-1, 1:-1] |= (image[1 + j : h - 1 + j, 1 + i : w - 1 + i] >= inner).astype(np.uint8) << np.uint8(k)
    return out


def texture_histogram(codes: np.ndarray, grid: int = GRID) -> np.ndarray:
    """256 shares for each cell of the grid, row by row; pixels beyond whole cells are left out."""
    ch, cw = codes.shape[0] // grid, codes.shape[1] // grid
    out = np.zeros((grid * grid, 256))
    for k in range(grid * grid):
        j, i = divmod(k, grid)
        cell = codes[j * ch : (j + 1) * ch, i * cw : (i + 1) * cw]
        if cell.size:
            out[k] = np.bincount(cell.ravel(), minlength=256) / cell.size
    return out.ravel()


def texture_descriptor(standardised: np.ndarray, w: int, h: int) -> np.ndarray:
    """The texture histogram of standardised pixels, put back to levels around 128."""
    levels = np.clip(np.asarray(standardised).reshape(h, w) * 64.0 + 128.0, 0, 255).astype(np.uint8)
    return texture_histogram(texture_codes(levels))


def tracker_descriptor(image: np.ndarray, box) -> np.ndarray:
    """What the tracker compares: the face's centre square at face size, equalised, as a texture histogram."""
    plane = image if image.ndim == 2 else image[..., 0]
    x, y, w, h = (int(v) for v in box)
    w, h = max(w, 1), max(h, 1)
    part = np.zeros((h, w), np.uint8)
    sx, sy = np.maximum(x + np.arange(w), 0), np.maximum(y + np.arange(h), 0)
    okx, oky = sx < plane.shape[1], sy < plane.shape[0]
    part[np.ix_(oky, okx)] = plane[np.ix_(sy[oky], sx[okx])]
    face = equalise(resize_nearest(centre_square(part), FACE_W, FACE_H))
    return texture_descriptor(face / 255.0, FACE_W, FACE_H)


def gradient_cells_of(images: np.ndarray, cell: int = HOG_CELL, bins: int = HOG_BINS) -> np.ndarray:
    """For each of several images of one size, per cell, gradient strength by direction over half a turn, shared between
    the two nearest bins."""
    n, height, width = images.shape
    p = np.pad(images.astype(np.float64), ((0, 0), (1, 1), (1, 1)), mode="edge")
    gx, gy = p[:, 1:-1, 2:] - p[:, 1:-1, :-2], p[:, 2:, 1:-1] - p[:, :-2, 1:-1]
    strength, angle = np.sqrt(gx * gx + gy * gy), np.arctan2(gy, gx)
    angle = np.where(angle < 0, angle + np.pi, angle)
    place = angle / np.pi * bins
    low = np.floor(place)
    share, low = place - low, low.astype(np.int64) % bins
    rows, cols = height // cell, width // cell
    where = (np.arange(height) // cell)[:, None] * cols + (np.arange(width) // cell)[None, :]
    where = where[None] + (np.arange(n) * rows * cols)[:, None, None]
    out = np.bincount((where * bins + low).ravel(), (strength * (1 - share)).ravel(), n * rows * cols * bins)
    out += np.bincount((where * bins + (low + 1) % bins).ravel(), (strength * share).ravel(), n * rows * cols * bins)
    return out.reshape(n, rows, cols, bins)


def gradient_cells(image: np.ndarray, cell: int = HOG_CELL, bins: int = HOG_BINS) -> np.ndarray:
    return gradient_cells_of(image[None], cell, bins)[0]


def gradient_descriptors(images: np.ndarray) -> np.ndarray:
    """Per image, blocks of 2 x 2 cells at every cell, each scaled to unit length (1e-6 under the root): 1764 numbers for 64 x 64."""
    c = gradient_cells_of(images)
    blocks = np.concatenate([c[:, :-1, :-1], c[:, :-1, 1:], c[:, 1:, :-1], c[:, 1:, 1:]], axis=3)
    return (blocks / np.sqrt((blocks * blocks).sum(axis=3, keepdims=True) + 1e-6)).reshape(len(images), -1)


def gradient_descriptor(image: np.ndarray) -> np.ndarray:
    return gradient_descriptors(image[None])[0]


def gradient_of_box(image: np.ndarray, box) -> np.ndarray:
    """The gradient descriptor of a part, equalised and resized; zeros where the part is empty."""
    part = crop(gray(image), *box)
    if not part.size:
        return np.zeros((HOG_SIDE // HOG_CELL - 1) ** 2 * 4 * HOG_BINS)
    return gradient_descriptor(resize_bilinear(equalise(part), HOG_SIDE, HOG_SIDE))


PALETTE = ((255, 64, 64), (64, 200, 64), (64, 128, 255), (255, 200, 0), (200, 64, 255), (0, 200, 200), (255, 128, 0))


def draw_box(image: np.ndarray, box, face_id: int | None = None) -> np.ndarray:
    """A copy with a one-pixel frame; gray images get the mean of the track's colour."""
    out = image.copy()
    h, w = image.shape[:2]
    x0, y0 = max(box[0], 0), max(box[1], 0)
    x1, y1 = min(box[0] + box[2], w) - 1, min(box[1] + box[3], h) - 1
    if x1 < x0 or y1 < y0:
        return out
    colour = (255, 255, 255) if face_id is None else PALETTE[face_id % len(PALETTE)]
    value = colour if image.ndim == 3 else sum(colour) // 3
    out[[y0, y1], x0 : x1 + 1] = value
    out[y0 : y1 + 1, x0] = value
    out[y0 : y1 + 1, x1] = value
    return out


# three columns by five rows a sign, a bit per dot, the upper left one highest
GLYPHS = dict(
    zip(
        "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ%.-_:",
        (
            0o75557, 0o26227, 0o71747, 0o71717, 0o55711, 0o74717, 0o74757, 0o71111, 0o75757, 0o75717, 0o25755, 0o65656, 0o34443, 0o65556, 0o74647, 0o74644,
            0o34553, 0o55755, 0o72227, 0o11152, 0o55655, 0o44447, 0o57755, 0o65555, 0o25552, 0o65644, 0o25563, 0o65655, 0o34216, 0o72222, 0o55557, 0o55552,
            0o55775, 0o55255, 0o55222, 0o71247, 0o51245, 0o00002, 0o00700, 0o00007, 0o02020,
        ),
    )
)


def draw_text(image: np.ndarray, x: int, y: int, text: str, value: int = 255) -> np.ndarray:
    """A copy with the text's signs, each three by five dots and one apart, its upper left corner at (x, y); small
    letters as capitals, unknown signs as gaps, dots beyond the image left out."""
    out = image.copy()
    for k, sign in enumerate(text.upper()):
        bits = GLYPHS.get(sign, 0)
        for dot in range(15):
            at = x + 4 * k + dot % 3, y + dot // 3
            if bits >> (14 - dot) & 1 and 0 <= at[0] < image.shape[1] and 0 <= at[1] < image.shape[0]:
                out[at[1], at[0]] = value
    return out


#: Bytes of results that `per_image` holds before it passes them on.
HELD = 8 << 20


def _room(value) -> int:
    """About the bytes that a value of a result takes."""
    if isinstance(value, np.ndarray):
        return value.nbytes
    if isinstance(value, (bytes, str)):
        return len(value)
    if isinstance(value, dict):
        return sum(map(_room, value.values()))
    return 32 + sum(map(_room, value)) if isinstance(value, (list, tuple)) else 32


def per_image(df: DataFrame, run: Callable[[np.ndarray, dict], list[dict]], schema: str, keep: list[str], data_col: str = "data") -> DataFrame:
    """Rows that `run` makes of each image: run(pixels, row's kept columns) gives dicts of the schema's columns.

    df has width, height, channels and the binary column. A null image gives no rows. A task holds one batch of
    images, and HELD bytes of results and those of one image more.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out, held = [], 0
            for row in pdf.to_dict("records"):
                if row[data_col] is None:
                    continue
                shape = (row["height"], row["width"]) if row["channels"] == 1 else (row["height"], row["width"], row["channels"])
                found = run(np.frombuffer(row[data_col], np.uint8).reshape(shape), row)
                out += found
                held += sum(map(_room, found))
                if held >= HELD:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=names)

    return df.select(*dict.fromkeys([*keep, "width", "height", "channels", data_col])).mapInPandas(go, schema)
