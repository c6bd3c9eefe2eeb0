"""A stand-in for a detector, so that the checked queries have detections to compare."""

from __future__ import annotations

import hashlib
import sys

from pyspark import cloudpickle

from shutterlake.operators.scoring import Detector

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STUB_CLASSES = ["ant", "Bee", "beetle", "moth", "person"]


def stub_detector() -> Detector:
    """A detector for tests: up to three objects read off the reference's md5."""

    def detect(references: list[str]) -> list[list[dict] | None]:
        out = []
        for reference in references:
            if not reference:
                out.append(None)
                continue
            digest = hashlib.md5(reference.encode()).digest()
            out.append([
                {
                    "class": STUB_CLASSES[digest[1 + i] % 5], "confidence": digest[4 + i] / 256,
                    "bbox": [0.0, 0.0, 64.0, 48.0], "class_id": digest[1 + i] % 5,
                }
                for i in range(digest[0] % 4)
            ])
        return out

    return detect
