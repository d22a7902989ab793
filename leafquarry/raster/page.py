"""A page's picture from its layers."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from leafquarry.codec import iw44, jb2
from leafquarry.formats import payloads
from leafquarry.functions.geometry import legal_subsample
from leafquarry.raster import bitmaps

THUMBNAIL_WIDTH = 128


class Decoded:
    """A layer as `operators.images` gives it, taken apart where it is used, so that only an error of a used layer counts."""

    def __init__(self, row: dict):
        self.row = row

    def __getitem__(self, name: str):
        if self.row["error"] is not None:
            raise ValueError(self.row["error"])
        return self.row[name]

    def inks(self) -> list[tuple[np.ndarray, tuple[int, int, int] | None]]:
        return [(np.frombuffer(i["data"], np.uint8).reshape(self["height"], self["width"]), None if i["r"] is None else (i["r"], i["g"], i["b"])) for i in self["inks"]]

    def image(self) -> np.ndarray:
        m = np.frombuffer(self["data"], np.uint8)
        return m.reshape(self["height"], self["width"], 3) if self["channels"] == 3 else m.reshape(self["height"], self["width"])


@dataclass
class Layers:
    """Payloads of a page by kind, in the order of the file; masks and wavelet layers also as `Decoded`, a background for the subsample that is asked for."""

    width: int
    height: int
    gamma: float = 2.2
    mask: bytes | Decoded | None = None
    dictionary: bytes | None = None
    background: list[bytes] | Decoded = field(default_factory=list)
    foreground: list[bytes] | Decoded = field(default_factory=list)
    palette: bytes | None = None
    thumbnail: list[bytes] | Decoded = field(default_factory=list)

    @property
    def bilevel(self) -> bool:
        return self.mask is not None and not self.background and not self.foreground

    @property
    def compound(self) -> bool:
        return self.mask is not None and bool(self.background) and (bool(self.foreground) or self.palette is not None)

    @property
    def color(self) -> bool:
        return self.compound or bool(self.background) or (self.bilevel and self.palette is not None)


def reduction(w: int, h: int, rw: int, rh: int) -> int:
    return next((r for r in range(1, 16) if -(-w // r) == rw and -(-h // r) == rh), 16)


def mask_image(x: Layers) -> jb2.Image | None:
    return jb2.decode(x.mask, jb2.decode(x.dictionary) if x.dictionary else None) if x.mask is not None else None


def mask(x: Layers, subsample: int = 1) -> tuple[np.ndarray, int]:
    """(ink levels, number of levels); no ink without a mask."""
    if x.mask is None:
        return np.zeros((-(-x.height // subsample), -(-x.width // subsample)), np.uint8), subsample * subsample + 1
    if isinstance(x.mask, Decoded):
        return x.mask.inks()[0][0], subsample * subsample + 1
    return jb2.compose(mask_image(x), subsample), subsample * subsample + 1


def inks(x: Layers, subsample: int = 1) -> list[tuple[np.ndarray, tuple[int, int, int] | None]]:
    """Ink levels of the mask, one map for each palette color in use (in order of their numbers), or one without a color."""
    if isinstance(x.mask, Decoded):
        return x.mask.inks()
    image = mask_image(x)
    if x.palette is None or x.foreground:
        return [(jb2.compose(image, subsample), None)]
    p = payloads.read_palette(x.palette)
    colors = [(c["r"], c["g"], c["b"]) for c in p["colors"]]
    of: dict[int, list] = {}
    for k, b in enumerate(image.blits):
        of.setdefault(p["blit_colors"][k] if k < len(p["blit_colors"]) else 0, []).append(b)
    return [(jb2.compose(jb2.Image(image.width, image.height, image.shapes, blits, image.inherited), subsample), colors[color]) for color, blits in sorted(of.items())]


def _whole(layer: list[bytes] | Decoded) -> np.ndarray:
    return layer.image() if isinstance(layer, Decoded) else iw44.decode(layer)


def _three(m: np.ndarray) -> np.ndarray:
    return m if m.ndim == 3 else np.repeat(m[..., None], 3, axis=2)


def background(x: Layers, subsample: int = 1, gamma: float = 0.0) -> np.ndarray:
    """The background at 1 / subsample of the page, white without one. Exact sizes are decoded or averaged, 4:3 and others scaled."""
    w, h = -(-x.width // subsample), -(-x.height // subsample)
    if not x.background:
        return np.full((h, w, 3), 255, np.uint8)
    if isinstance(x.background, Decoded):
        full, image = (x.background["full_width"], x.background["full_height"]), lambda own: x.background.image()
    else:
        decoder = iw44.Decoder()
        for c in x.background:
            decoder.chunk(c)
        full, image = (decoder.head["width"], decoder.head["height"]), decoder.image
    red = reduction(x.width, x.height, *full)
    if subsample == red:
        m = image(1)
    elif subsample > red and subsample % red == 0 and subsample // red in (2, 4, 8):
        m = image(subsample // red)
    elif subsample * 3 == red * 4:
        m = bitmaps.downsample_43(image(1))
    else:
        m = bitmaps.scale(image(1), w, h)
    m = _three(m)
    m = m if m.shape[:2] == (h, w) else bitmaps.scale(m, w, h)
    return bitmaps.correct(m, _correction(x, gamma))


def _correction(x: Layers, gamma: float) -> float:
    """gamma 0 asks for no correction."""
    return min(10.0, max(0.1, gamma / x.gamma)) if gamma > 0 and x.gamma > 0 else 1.0


def picture(x: Layers, subsample: int = 1, gamma: float = 0.0, inverted: bool = False) -> np.ndarray:
    """The whole page as (rows, columns, 3) bytes, row 0 at the bottom."""
    legal_subsample(subsample)
    base = background(x, subsample, gamma)
    if x.mask is not None:
        grays = subsample * subsample + 1
        for ink, color in inks(x, subsample):
            if color is not None:
                base = bitmaps.stencil(base, ink, grays, np.array(color), _correction(x, gamma))
            elif x.foreground:
                base = bitmaps.stencil(base, ink, grays, _three(_whole(x.foreground)), _correction(x, gamma))
            else:
                base = bitmaps.stencil(base, ink, grays, np.zeros(3, np.uint8))
    return bitmaps.invert(base) if inverted else base


def thumbnail(x: Layers) -> np.ndarray:
    """The embedded thumbnail, else the page at a width of THUMBNAIL_WIDTH."""
    if x.thumbnail:
        return _three(_whole(x.thumbnail))
    return bitmaps.scale(picture(x), THUMBNAIL_WIDTH, max(1, x.height * THUMBNAIL_WIDTH // max(1, x.width)))
