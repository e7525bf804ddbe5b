"""Recognition of an image by two models: a detector of text regions and a recognizer of lines. The models are
callables; all between them is here."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from . import image
from .recognition import Line

#: The recognizer's normalization, and the sides of both models' inputs.
MEAN, STD = (0.5, 0.5, 0.5), (0.5, 0.5, 0.5)
LONGEST, HEIGHT, WIDEST = 960, 48, 480

Box = tuple[int, int, int, int]


def _round(x: float) -> int:
    return int(np.floor(x + 0.5))


def detector_dims(w: int, h: int) -> tuple[int, int]:
    """Detector input: longest side 960 at most, 16 at least, rounded up to 32."""
    r = min(1.0, LONGEST / max(w, h))
    return tuple(-(-max(16, _round(x * r)) // 32) * 32 for x in (w, h))


def recognizer_width(w: int, h: int) -> int:
    """Recognizer input 48 high: 8 to 480 wide, rounded up to 8."""
    return -(-max(8, min(WIDEST, _round(HEIGHT * w / h))) // 8) * 8


def unclip(box: Box, scale_x: float, scale_y: float, w: int, h: int) -> Box:
    """A detector box scaled to the image, clamped, and widened."""
    x0, x1 = (max(0, min(w, _round(x * scale_x))) for x in (box[0], box[2]))
    y0, y1 = (max(0, min(h, _round(y * scale_y))) for y in (box[1], box[3]))
    bw, bh = x1 - x0, y1 - y0
    # a box without area has no offset to widen by
    offset = _round(bw * bh / (2 * (bw + bh)) * 1.5) if bw + bh else 0
    ex, ey = max(offset, _round(bw * 0.1)), max(offset, _round(bh * 0.4))
    return max(0, x0 - ex), max(0, y0 - ey), min(w, x1 + ex), min(h, y1 + ey)


def text_boxes(boxes: list[Box], scale_x: float, scale_y: float, w: int, h: int) -> list[Box]:
    """Boxes of an image: widened, those under 3 pixels dropped, by y then x."""
    wide = [unclip(b, scale_x, scale_y, w, h) for b in boxes]
    return sorted((b for b in wide if b[2] - b[0] >= 3 and b[3] - b[1] >= 3), key=lambda b: (b[1], b[0]))


def crop(img: np.ndarray, box: Box) -> np.ndarray:
    return img[box[1] : box[3], box[0] : box[2]]


@dataclass(frozen=True)
class ModelEngine:
    """An OCR engine of two models. ``detect`` gets a (1, 3, height, width) tensor and returns a map of probabilities;
    ``recognize`` gets a (1, 3, 48, width) tensor and a language and returns logits by time and class; ``letters`` has
    each language's classes but the blank."""

    detect: Callable[[np.ndarray], np.ndarray]
    recognize: Callable[[np.ndarray, str], np.ndarray]
    letters: dict[str, list[str]]

    def __call__(self, data: bytes, language: str) -> list[Line]:
        img = image.decode_image(data)
        try:
            img = image.preprocess(img)
        except Exception:  # recognition can still try the image as it is
            img = img[..., :3]
        h, w = img.shape[:2]
        dw, dh = detector_dims(w, h)
        prob = np.asarray(self.detect(image.to_tensor(image.resize(img, dw, dh))[None]))
        ph, pw = prob.shape[-2:]
        found = text_boxes(image.components(prob.reshape(ph, pw)), w / pw, h / ph, w, h)
        return [line for box in found if (line := self.line(crop(img, box), language)).text]

    def line(self, img: np.ndarray, language: str) -> Line:
        """A line's parts, cut at word gaps where it is wide, joined; their mean confidence."""
        parts = []
        for a, b in image.split_wide(img, WIDEST):
            part = img[:, a:b]
            width = recognizer_width(part.shape[1], part.shape[0])
            logits = self.recognize(image.to_tensor(image.resize(part, width, HEIGHT), MEAN, STD)[None], language)
            parts.append(image.ctc(np.asarray(logits).reshape(-1, np.shape(logits)[-1]), self.letters.get(language, [])))
        kept = [(text, p) for text, p in parts if text]
        return Line(" ".join(text for text, _ in kept), float(np.mean([p for _, p in kept])) if kept else 0.0)
