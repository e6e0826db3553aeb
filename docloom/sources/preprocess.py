"""Image preparation before recognition, for environments that have Pillow.

Pixels are worked on in numpy; Pillow (imported in the worker, on first use) only decodes, filters and
encodes. Nothing is written beside the sources: prepared bytes stay in the DataFrame.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Share of the page's height that holds the header; contrast and sharpness of either preparation.
HEADER = 0.28
CONTRAST, STRONG_CONTRAST, STRONG_SHARPNESS = 2.0, 2.2, 1.8


def border(pixels: np.ndarray) -> tuple[int, int, int, int]:
    """(left, top, right, bottom) of what differs from the top-left pixel; the whole if nothing does."""
    differs = (pixels != pixels[0, 0]).any(-1)
    rows, columns = np.flatnonzero(differs.any(1)), np.flatnonzero(differs.any(0))
    if not len(rows):
        return 0, 0, pixels.shape[1], pixels.shape[0]
    return int(columns[0]), int(rows[0]), int(columns[-1]) + 1, int(rows[-1]) + 1


def header(width: int, height: int) -> tuple[int, int, int, int]:
    """The box of a page's header."""
    return 0, 0, width, int(height * HEADER)


def _upright(content: bytes):
    from PIL import Image, ImageOps

    return ImageOps.exif_transpose(Image.open(io.BytesIO(content)))


def _encoded(image, kind: str = "JPEG") -> bytes:
    out = io.BytesIO()
    image.save(out, kind)
    return out.getvalue()


def prepared(content: bytes) -> bytes:
    """Upright, without its border, gray, of more contrast, sharpened, twice the size."""
    from PIL import ImageEnhance, ImageFilter

    image = _upright(content)
    image = image.crop(border(np.asarray(image.convert("RGB")))).convert("L")
    image = ImageEnhance.Contrast(image).enhance(CONTRAST).filter(ImageFilter.SHARPEN)
    return _encoded(image.resize((image.width * 2, image.height * 2)))


def strengthened(content: bytes) -> bytes:
    """Upright, gray, of more contrast and sharpness, twice the size."""
    from PIL import ImageEnhance

    image = ImageEnhance.Contrast(_upright(content).convert("L")).enhance(STRONG_CONTRAST)
    image = ImageEnhance.Sharpness(image).enhance(STRONG_SHARPNESS)
    return _encoded(image.resize((image.width * 2, image.height * 2)))


def cropped_header(content: bytes) -> bytes:
    """The top of a page."""
    from PIL import Image

    image = Image.open(io.BytesIO(content))
    return _encoded(image.crop(header(*image.size)), image.format or "JPEG")


def applied(images: DataFrame, step: Callable[[bytes], bytes] = prepared) -> DataFrame:
    """path, content, error of images (path, content) after a step; a failure keeps the content and its message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out.append((path, step(bytes(content)), ""))
                except Exception as e:  # noqa: BLE001 - an image that can't be prepared is its own failure
                    out.append((path, bytes(content), str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "content", "error"])

    return images.select("path", "content").mapInPandas(run, "path string, content binary, error string")
